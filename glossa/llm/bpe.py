"""Byte-pair encoding and decoding with a contiguous rank array.

A word's symbols sit in one array beside an array with the merge rank of each
adjacent pair. A round scans the ranks for the minimum, joins that pair, deletes
its boundary and refreshes the two neighbouring ranks. Words of more than
`SHORT` symbols use a heap instead, so that a text without spaces stays
n log n; both orders of merges are the same.

Reads the `tokenizers` JSON of a BPE model with a word-end suffix, byte-level
alphabet and the NFC, white-space, lower-case normalisation. Results equal that
library's encode and decode; tests hold them against it.

Defined cases: a null or empty text has no tokens and decodes to the empty
text; special tokens written in a text become their ids; texts of any length
are encoded whole; of equal ranks the left pair is joined first; null ids stay
null; repeated rows are each encoded; an empty table gives an empty result;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import load, map_arrow, prepare, texts_of

SHORT = 48
CACHE_WORDS, CACHE_PIECES = 200_000, 400_000
NONE = 1 << 60
#: White space of Unicode beyond ASCII, in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """One vocabulary, with bounded memos of words and pieces."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pair[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t.encode() for t, i in [*self.vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = [self.vocab.get(x, -1) for x in letters]
        self.last = [self.vocab.get(x + self.suffix, -1) for x in letters]
        self.pieces_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.specials = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in self.special) + b")") if self.special else None
        self.words: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        pair = self.pair
        absent = (NONE, 0)
        ranks = [pair.get(p, absent)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            ids[i] = pair[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pair.get((ids[i - 1], ids[i]), absent)[0]
            if i < len(ranks):
                ranks[i] = pair.get((ids[i], ids[i + 1]), absent)[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        pair, n = self.pair, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or pair.get((ids[i], ids[j]), (0, -1))[1] != made:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := pair.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (p[0], a, p[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self.memo.get(piece)
        if got is None:
            raw = piece.encode()
            ids = [self.inner[b] for b in raw[:-1]]
            ids.append(self.last[raw[-1]])
            ids = [x for x in ids if x >= 0]
            got = tuple(self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids))
            if len(self.memo) >= CACHE_PIECES:
                self.memo.clear()
            if len(piece) < 64:
                self.memo[piece] = got
        return got

    def word(self, raw: bytes) -> tuple[int, bytes, bytes]:
        """Tokens of one space-free chunk: count, ids in decimal, decoded text."""
        s = raw.decode("utf-8", "replace")
        if not s.isascii():
            s = unicodedata.normalize("NFC", s).replace("Σ", "σ")
        ids = [i for p in self.pieces_of.findall(s.lower()) for i in self.piece(p)]
        got = (len(ids), b" ".join(b"%d" % i for i in ids), b" ".join([self.text[i] for i in ids]))
        if len(raw) < 64:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[raw] = got
        return got

    def plain(self, text: bytes) -> list[tuple[int, bytes, bytes]]:
        if not text.isascii():
            text = WIDE_SPACE.sub(b" ", text)
        get, word = self.words.get, self.word
        return [get(w) or word(w) for w in text.split()]

    def encode(self, text: bytes) -> tuple[int, bytes, bytes]:
        """Of a whole text: count, ids joined by spaces, decoded text."""
        if self.specials and b"<|" in text and self.specials.search(text):
            found = []
            for i, part in enumerate(self.specials.split(text)):
                found += [(1, b"%d" % self.special[part.decode()], part)] if i % 2 else self.plain(part)
        else:
            found = self.plain(text)
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), b" ".join([x[1] for x in found]), b" ".join([x[2] for x in found])


@lru_cache(maxsize=1)
def coder(path: str) -> WordBpe:
    """The worker's coder for a vocabulary file, loaded once."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids
    (array<int>) and the decoded text. `path` names the vocabulary file on the
    executors; None takes the installed one."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or default_vocabulary())
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in texts_of(b):
                n, ids, decoded = own.encode(t)
                row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for o, x in zip(out, row + ((list(map(int, ids.split())), decoded.decode()) if with_ids else ()), strict=False):
                    o.append(x)
            cols = [b.column(b.schema.get_field_index("doc_id")), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op9_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"))
