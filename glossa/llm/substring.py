"""Substring deduplication by recompression.

A text is a string of word symbols. Rounds replace runs and then pairs of
neighbouring symbols by new ones: a run of two equal symbols gets one name, and
a pair (a, b) gets one where a falls in the left and b in the right half of the
alphabet. Halves and names are hashes of the symbols' contents, so every task
gives equal strings equal names without a dictionary; a hash clash can only
cost a needless comparison. After the rounds a symbol spans at most 8 words, and
whether it exists depends on at most 7 words on either side. So of two equal
windows of `window` words both hold the same symbols in their core, 8 words from
the start up to 16 from the end, and any 8 words hold a symbol's start.

Spark's part: each window elects the smallest symbol of its core; the elected
symbols, named by the 23 words around their start, are counted over the corpus.
A window whose elected symbol occurs once is unique. The others are verified
by their words: 96 bits of a cryptographic digest (BLAKE2b) of the window's
text, again counted over the corpus, and the words under windows counted twice
or more go. Counting adds up within tasks before it shuffles, and the way back
is a join that Spark can split, so common passages and large groups of copies
stay spread. Only texts that have something to look at are shuffled: a sieve of
bounded size lets the others stay where they are.

Defined cases: null and empty texts have no words; texts shorter than a window
lose nothing; overlapping windows of one text count as different starts; a
repeated row is another text; an empty table gives an empty result; row order,
null ids and extra columns, whatever their names, do not matter. A row's number
is its file's and its place there, or is written, so a lost executor changes no
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import load, map_arrow, materialize, passing, prepare, release_shuffles, remove, sieve, sieve_hash, sifted, texts_of, with_row_ids

WINDOW = 35
MARGIN, CONTEXT_LEFT, CONTEXT_RIGHT = 8, 8, 15
CACHE_WORDS = 150_000
CHUNK_WORDS = 200_000
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
BASE = 0xD1342543DE82EF95
DIGEST_BYTES = 12
MOST = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * M1
    x = (x ^ (x >> U(29))) * M2
    return x ^ (x >> U(32))


class Words:
    """64-bit symbols of words, with a bounded memo."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def symbols(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.int64).view(np.uint64)
        except KeyError:
            if len(memo) > CACHE_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
            return np.array([memo[w] for w in words], np.int64).view(np.uint64)


def merged(s: np.ndarray, start: np.ndarray, owner: np.ndarray, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace the symbols at `at` and after by `names`."""
    s = s.copy()
    s[at] = names
    keep = np.ones(len(s), bool)
    keep[at + 1] = False
    return s[keep], start[keep], owner[keep]


def recompress(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts of the high-level symbols of concatenated texts."""
    s, start, who = symbols, np.arange(len(symbols)), owner
    if len(s) > 1:  # runs of exactly two
        equal = np.concatenate([[False], (s[1:] == s[:-1]) & (who[1:] == who[:-1]), [False]])
        at = np.flatnonzero(equal[1:-1] & ~equal[:-2] & ~equal[2:])
        s, start, who = merged(s, start, who, at, mix(s[at] * M3 + U(2)))
    for salt in (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)):  # pairs
        right = (s * salt) >> U(63) == U(1)
        at = np.flatnonzero(~right[:-1] & right[1:] & (who[1:] == who[:-1]))
        s, start, who = merged(s, start, who, at, mix(s[at] * M3 + s[at + 1] * M2 + salt))
    return s, start


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def prefix(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints of substrings: prefix sums, and the inverse powers."""
    n = len(symbols)
    power, inverse = np.empty(n, np.uint64), np.full(n + 1, U(pow(base, -1, 1 << 64)), np.uint64)
    power[:] = U(base)
    power[:1] = U(1)
    inverse[:1] = U(1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * np.cumprod(power), dtype=np.uint64)]), np.cumprod(inverse)


def fingerprints(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    return mix((sums[0][start + length] - sums[0][start]) * sums[1][start])


def elect(symbols: np.ndarray, owner: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word the name of the symbol that starts there (else the largest
    number), and per window start the name that its core elects (0: no window)."""
    names, start = recompress(symbols, owner)
    h = np.full(len(symbols), MOST, np.uint64)
    h[start] = np.maximum(names, U(1))
    core = window - 3 * MARGIN + 1
    chosen = np.zeros(len(symbols), np.uint64)
    inner = slide(h[MARGIN:], core, np.minimum)
    n = min(len(inner), len(valid))
    chosen[:n] = np.where(valid[:n], inner[:n], U(0))
    return h, chosen


def spans(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each word, and whether a window starts at it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    return owner, np.arange(len(owner)) + window <= ends[owner] if len(owner) else np.zeros(0, bool)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words in groups of about CHUNK_WORDS, with the first index."""
    group: list[list[bytes]] = []
    first, size = 0, 0
    for i, t in enumerate(texts):
        group.append(t.split())
        size += len(group[-1])
        if size >= CHUNK_WORDS:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def elected(h: np.ndarray, chosen: np.ndarray, window: int) -> np.ndarray:
    """Words at which an elected symbol starts."""
    core = window - 3 * MARGIN + 1
    padded = np.concatenate([np.zeros(MARGIN + core - 1, np.uint64), chosen])
    best = slide(padded, core, np.maximum)[: len(h)]  # over the windows with the word in their core
    return np.flatnonzero((best == h) & (h != MOST))


def anchors(rows: DataFrame, window: int) -> DataFrame:
    """(name, row_id, pos) of the elected symbols of (row_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids = b.column(b.schema.get_field_index("row_id")).to_numpy()
            for first, group in chunks(texts_of(b)):
                group = [w if len(w) >= window else [] for w in group]
                sizes = np.array([len(w) for w in group], np.int64)
                owner, valid = spans(sizes, window)
                if not valid.any():
                    continue
                x = words.symbols([w for ws in group for w in ws])
                at = elected(*elect(x, owner, valid, window), window)
                names = fingerprints(prefix(x, BASE), at - CONTEXT_LEFT, CONTEXT_LEFT + CONTEXT_RIGHT)
                begin = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(ids[first + owner[at]]), pa.array((at - begin[owner[at]]).astype(np.int32))], names=["name", "row_id", "pos"]
                )

    return map_arrow(rows.select("row_id", "text"), run, "name long, row_id long, pos int")


KEY = np.dtype([("k1", "<i8"), ("k2", "<i4")])


def digests(words: list[bytes], starts: list[int], window: int) -> bytes:
    """The digests of the windows at `starts`, one after the other. No word has a
    space, so the words joined by spaces stand for them exactly."""
    if not starts:
        return b""
    text = memoryview(b" ".join(words))
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
    return b"".join([hashlib.blake2b(text[edge[p] : edge[p + window] - 1], digest_size=DIGEST_BYTES).digest() for p in starts])


def windows(rows: DataFrame, window: int) -> DataFrame:
    """(k1, k2, row_id, pos) of the windows of (row_id, text, hits) that elect a
    symbol at one of the positions `hits`."""
    core = window - 3 * MARGIN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids = b.column(b.schema.get_field_index("row_id")).to_numpy()
            hits = b.column(b.schema.get_field_index("hits"))
            for first, group in chunks(texts_of(b)):
                sizes = np.array([len(w) for w in group], np.int64)
                owner, valid = spans(sizes, window)
                begin = np.cumsum(sizes) - sizes
                x = words.symbols([w for ws in group for w in ws])
                h, chosen = elect(x, owner, valid, window)
                at = np.concatenate([np.asarray(hits[first + i].as_py(), np.int64) + begin[i] for i in range(len(group))])
                shared = np.zeros(len(x), np.uint64)
                shared[at] = h[at]
                # a window counts if a shared symbol in its core is the one it elects
                padded = np.concatenate([shared[MARGIN:], np.zeros(MARGIN + core, np.uint64)])
                take = np.zeros(len(x), bool)
                for i in range(core):
                    take |= padded[i : i + len(x)] == chosen
                at = np.flatnonzero(take & (chosen != 0))
                pos = at - begin[owner[at]]
                each = np.searchsorted(owner[at], np.arange(len(group) + 1))
                keys = np.frombuffer(b"".join(digests(ws, pos[a:b].tolist(), window) for ws, a, b in zip(group, each[:-1], each[1:], strict=True)), KEY)
                yield pa.RecordBatch.from_arrays([pa.array(keys["k1"]), pa.array(keys["k2"]), pa.array(ids[first + owner[at]]), pa.array(pos.astype(np.int32))], names=["k1", "k2", "row_id", "pos"])

    return map_arrow(rows.select("row_id", "text", "hits"), run, "k1 long, k2 int, row_id long, pos int")


def shared_positions(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """row_id and the positions of `table` whose keys occur twice or more. The
    keys are written first: the counting's shuffle files go before the join
    writes its own, and Spark can split a hot key of a join of two tables."""
    spark = table.sparkSession
    twice, twice_at = materialize(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), "twice")
    release_shuffles(spark)
    out, _ = materialize(table.join(twice, keys, "left_semi").groupBy("row_id").agg(F.collect_list("pos").alias(name)), name)
    remove(spark, twice_at)
    return out


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row_id, starts): the windows of (row_id, text) that start anywhere else
    too. `rows` must be written: row_id has to be the same in every scan."""
    if window < 3 * MARGIN:
        raise ValueError(f"a window has at least {3 * MARGIN} words")
    spark = rows.sparkSession
    prepare(spark)
    found, found_at = materialize(anchors(rows, window), "elected")
    hits = shared_positions(found, ["name"], "hits")
    remove(spark, found_at)
    release_shuffles(spark)
    asked = sifted(rows, "row_id", sieve(hits.select("row_id")))
    candidates, candidates_at = materialize(windows(asked.join(hits, "row_id"), window), "windows")
    release_shuffles(spark)
    starts = shared_positions(candidates, ["k1", "k2"], "starts")
    remove(spark, candidates_at)
    release_shuffles(spark)
    return starts


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """All columns of `docs` but text, with n_words, n_removed, kept_sha256; with
    `with_text` also kept_text (the text itself where nothing was removed)."""
    spark = docs.sparkSession
    prepare(spark)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = with_row_ids(docs.select("text", *[F.col(f"`{c}`").alias(own) for c, own in inner.items()]), "numbered")
    starts = repeated_windows(rows.select("row_id", "text"), window)
    made = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if with_text else {})

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        found, out = b.column(b.schema.get_field_index("starts")), [[] for _ in range(4)]
        for i, t in enumerate(texts_of(b)):
            words, gone = t.split(), 0
            n, at = len(words), found[i].as_py()
            if at:
                delta = np.zeros(n + 1, np.int64)
                np.add.at(delta, np.asarray(at), 1)
                np.add.at(delta, np.asarray(at) + window, -1)
                kept = np.cumsum(delta)[:n] == 0
                words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
                gone = n - len(words)
            joined = b" ".join(words)
            for o, x in zip(out, (n, gone, hashlib.sha256(joined).hexdigest(), joined if gone else t), strict=True):
                o.append(x)
        cols = [pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)][: len(made)]
        if with_text:
            cols[3] = cols[3].cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in inner.values()] + cols, names=[*inner.values(), *made])

    bits = sieve(starts.select("row_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cut(b)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # with the sieve in the same worker
            yield cut(b.filter(pa.array(passing(b.column(b.schema.get_field_index("h")).to_numpy(zero_copy_only=False), bits.value, keep=False))))

    touched = sifted(rows, "row_id", bits).join(starts, "row_id", "left").select(*inner.values(), "text", "starts")
    others = rows.select(*inner.values(), "text", F.lit(None).cast("array<int>").alias("starts"), sieve_hash("row_id").alias("h"))
    schema = ", ".join([*(f"{own} {docs.schema[c].dataType.simpleString()}" for c, own in inner.items()), *(f"{n} {k}" for n, k in made.items())])
    out = map_arrow(touched, run, schema).unionByName(map_arrow(others, untouched, schema))
    return out.select(*[F.col(own).alias(c) for c, own in inner.items()], *made)


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
