"""Near-duplicate detection with ProbMinHash.

A text is a weighted set: its `WORDS`-word shingles with their counts (words
without A-Z case; a shorter text is one shingle). Each shingle is a Poisson
process whose rate is its weight; its arrivals go to registers at random, and a
register keeps the shingle that arrives first. A shingle stops once its next
arrival is later than every register's (Ertl, 2020). Two texts agree in a
register with the probability Jaccard similarity of their weights. Bands of
registers bring candidates together, and candidates are verified by the exact
probability Jaccard of the whole texts.

Exact copies are one node from the start. In a band's bucket the node that
shares most buckets is compared with all others, and links merge nodes into components. After that only
nodes of different components can add anything: in each bucket that still holds
several, the nodes outside its largest component meet all others. Most of these
pairs are far below the threshold, so a second signature of `FINE` registers, of
which 2 bits each are kept, decides within the join which pairs leave it; a pair
leaves at the first band that it shares. The second signature loses a
pair at 0.8 with probability 1e-5. That holds for texts of many shingles; pairs
with a text under `SHORT` shingles all leave. So no bucket's pairs are all
written out, and no link between two components that share a bucket is lost
otherwise.
At 0.8, 30 bands of 6 registers miss a pair with probability 1.1e-4.

Defined cases: a null text is the empty text; texts without words are one class;
repeated rows and equal texts are one class; null ids take part and rank last;
an empty table gives an empty result; extra columns are not read, or kept by
`deduplicated`. Row numbers and texts are written once and read from there, so
a lost executor changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from glossa.llm.common import load, map_arrow, materialize, prepare, release_shuffles, remove, sieve, sifted, texts_of
from glossa.llm.graph import components
from glossa.llm.substring import M1, M2, M3, Words, chunks, mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
#: Registers of the second signature, and those that may differ: the expected
#: number at 0.8, 0.75 * 0.2 * FINE, and 4.5 standard deviations.
FINE, FINE_DIFFER = 1024, 205
#: Under so many shingles a text wins many registers with one shingle, and its
#: pairs go to verification whatever the second signature says.
SHORT = 48
FINE_SALT = np.uint64(0x5851F42D4C957F2D)
PAIRED = 0x5555555555555555
#: Arrivals that a shingle draws at once after its first.
BLOCK = 16
U = np.uint64
STEPS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * M1) | U(1)


def shingles(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a text's word symbols, and their counts."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(n, WORDS)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += mix(symbols[j : n - k + 1 + j]) * STEPS[j]
    return np.unique(mix(h), return_counts=True)


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """texts x registers: the first shingle to arrive at each (0: none)."""
    first = np.full(texts * registers, np.inf)
    out = np.zeros(texts * registers, np.uint64)
    t, step, block = np.zeros(len(elements)), 0, 1
    while len(elements):
        turn = mix(np.arange(step + 1, step + block + 1, dtype=np.uint64) * M3)
        a = mix(elements[:, None] + turn)
        b = mix(a + M2)
        times = t[:, None] + np.cumsum(-np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / weights[:, None]
        at = (owner[:, None] * registers + (b % U(registers)).astype(np.int64)).ravel()
        flat = times.ravel()
        better = np.flatnonzero(flat < first[at])
        at, flat = at[better], flat[better]
        np.minimum.at(first, at, flat)
        won = first[at] == flat
        out[at[won]] = elements[better[won] // block]
        last = first.reshape(texts, registers).max(1)
        t = times[:, -1]
        alive = t < last[owner]
        owner, elements, weights, t = owner[alive], elements[alive], weights[alive], t[alive]
        step, block = step + block, BLOCK
    return out.reshape(texts, registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """texts x bands: one number for each band of registers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.zeros(parts.shape[:2], np.uint64) + mix(np.arange(BANDS, dtype=np.uint64) * M3 + U(1))
    for r in range(ROWS):
        h = mix(h * M2 + parts[:, :, r])
    return h


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted elements, weights); two empty ones are equal."""
    union = np.union1d(a[0], b[0])
    if not len(union):
        return 1.0
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])] = a[1]
    y[np.searchsorted(union, b[0])] = b[1]
    both, n = np.unique(np.stack([x, y])[:, (x > 0) & (y > 0)], axis=1, return_counts=True)
    return float(sum(k / np.maximum(x / p, y / q).sum() for p, q, k in zip(*both, n, strict=True)))


def signed(rows: DataFrame) -> DataFrame:
    """`rows` (row_id, digest, text and more) with `bands`, its bands' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            texts = [t.lower() for t in texts_of(b)]
            out = np.zeros((len(texts), BANDS), np.uint64)
            for first, group in chunks(texts):
                x = words.symbols([w for ws in group for w in ws])
                ends = np.cumsum([len(ws) for ws in group])
                sets = [shingles(x[e - len(ws) : e]) for e, ws in zip(ends.tolist(), group, strict=True)]
                owner = np.repeat(np.arange(len(group)), [len(s[0]) for s in sets])
                sig = signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), len(group))
                out[first : first + len(group)] = bands_of(sig)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(texts) + 1), BANDS, dtype=np.int32)), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, bands], names=[*b.schema.names, "bands"])

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField("bands", ArrayType(LongType()))]))


def fine_prints(texts: DataFrame) -> DataFrame:
    """(node, short, f0, f1, ...) of (node, text): whether it has under SHORT
    shingles, and 2 bits of each register of the second signature."""
    names = [f"f{i}" for i in range(FINE // 32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = Words(), np.arange(0, 64, 2, dtype=np.uint64)
        for b in batches:
            out, short = [], []
            for _, group in chunks([t.lower() for t in texts_of(b)]):
                sets = [shingles(words.symbols(ws)) for ws in group]
                short += [len(s[0]) < SHORT for s in sets]
                owner = np.repeat(np.arange(len(group)), [len(s[0]) for s in sets])
                sig = signatures(owner, mix(np.concatenate([s[0] for s in sets]) ^ FINE_SALT), np.concatenate([s[1] for s in sets]).astype(float), len(group), FINE)
                out.append(np.bitwise_or.reduce((sig.reshape(len(group), -1, 32) & U(3)) << place, axis=2))
            bits = np.concatenate(out).view(np.int64) if out else np.empty((0, len(names)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), pa.array(short, pa.bool_()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(names))]], names=["node", "short", *names])

    return map_arrow(texts.select("node", "text"), run, "node long, short boolean, " + ", ".join(f"{n} long" for n in names))


def differing(a: str, b: str) -> Column:
    """Registers of the second signature that differ."""
    total = F.lit(0)
    for i in range(FINE // 32):
        x = F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(PAIRED)))
    return total


def similarities(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), {}

        def of(node: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingles(words.symbols(text.lower().split()))
            return known[node]

        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            s = [probability_jaccard(of(i, x), of(j, y)) for i, j, x, y in zip(a.to_pylist(), b.to_pylist(), texts_of(batch, "text_a"), texts_of(batch, "text_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), run, "a long, b long, similarity double")


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """`docs` with class_row, class_id, class_size and row_id: the class of every
    row of `docs` (doc_id, text and more; the names added must be free). The
    class is named by its row with the least id, class_row; class_id is its id."""
    table, label = labelled(docs, threshold)
    named = table.select("row_id", "doc_id", "digest").join(label, "digest")
    names, _ = materialize(named.groupBy("label").agg(F.min(least_id()).alias("best"), F.count(F.lit(1)).alias("class_size")), "names")
    return named.join(names, "label").select("row_id", "doc_id", F.col("best.row_id").alias("class_row"), F.col("best.doc_id").alias("class_id"), "class_size")


def deduplicated(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The row with the least id of each class of `docs`, all columns. Only the
    rows that may go are shuffled: a sieve of them lets the others stay."""
    spark = docs.sparkSession
    inner = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    table, label = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(own) for c, own in inner.items()]), threshold)
    named = table.select("row_id", "doc_id", "digest").join(label, "digest")
    best = named.groupBy("label").agg(F.min(least_id())["row_id"].alias("row_id"))
    gone, _ = materialize(named.select("row_id").join(best.select("row_id"), "row_id", "left_anti"), "gone")
    rows, bits = table.select("row_id", *inner.values()), sieve(gone)
    stay = sifted(rows, "row_id", bits, keep=False).unionByName(sifted(rows, "row_id", bits).join(gone, "row_id", "left_anti"))
    release_shuffles(spark)
    return stay.select(*[F.col(own).alias(c) for c, own in inner.items()])


def least_id() -> Column:
    """Orders rows by id, those without one last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")


def labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """`docs` as written with row_id, digest and bands, and (digest, label) of
    the distinct texts."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.withColumn("row_id", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    table, _ = materialize(signed(rows), "signed")
    nodes, _ = materialize(table.groupBy("digest").agg(F.min(F.struct("row_id", "bands")).alias("own")).select("digest", F.col("own.row_id").alias("node"), F.col("own.bands").alias("bands")), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets, buckets_at = materialize(buckets, "buckets")
    release_shuffles(spark)
    together, together_at = materialize(spread.join(buckets, "bucket"), "together")
    release_shuffles(spark)
    # a bucket's hub is its node with the largest buckets: it is likely to be in the middle
    ranked, ranked_at = materialize(together.join(together.groupBy("node").agg(F.sum("n").alias("rank")), "node").select("bucket", "node", "rank"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("hub"))
    hubs, hubs_at = materialize(hubs, "hubs")
    members, members_at = materialize(ranked.select("bucket", "node").join(hubs, "bucket"), "members")
    release_shuffles(spark)
    # the texts of the nodes that share a bucket; the sieve keeps the others from the shuffle
    shared, shared_at = materialize(members.select("node").distinct(), "shared")
    texts, texts_at = materialize(sifted(table.select(F.col("row_id").alias("node"), "text"), "node", sieve(shared)).join(shared, "node"), "texts")
    release_shuffles(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        return similarities(pairs.join(side("a"), "a").join(side("b"), "b")).where(F.col("similarity") >= threshold).select("a", "b")

    labels = components(linked(members.where("hub != node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()))
    # hubs have met all members of their buckets
    named = members.where("hub != node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).where("n > main.n").select("bucket", F.col("main.label").alias("main"))
    mixed, mixed_at = materialize(mixed, "mixed")
    left, left_at = materialize(named.join(mixed, "bucket"), "left")
    prints, prints_at = materialize(fine_prints(texts.join(left.select("node").distinct(), "node")).join(nodes.select("node", "bands"), "node"), "prints")
    sides, sides_at = materialize(left.join(prints, "node"), "sides")
    o, m = sides.where("label != main").alias("o"), sides.alias("m")
    first = F.array_position(F.zip_with("o.bands", "m.bands", lambda x, y: x == y), F.lit(True)) == F.array_position("o.bands", F.col("o.bucket"))
    once = (F.col("m.label") == F.col("m.main")) | (F.col("o.node") < F.col("m.node"))
    close = F.col("o.short") | F.col("m.short") | (differing("o", "m") <= FINE_DIFFER)
    meet = (F.col("o.bucket") == F.col("m.bucket")) & (F.col("o.label") != F.col("m.label")) & once & close & first
    pairs = o.join(m, meet).select(F.least("o.node", "m.node").alias("a"), F.greatest("o.node", "m.node").alias("b"), F.least("o.label", "m.label").alias("x"), F.greatest("o.label", "m.label").alias("y"))
    pairs, pairs_at = materialize(pairs.distinct(), "pairs")
    found = linked(pairs).join(pairs, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    over = components(found).select(F.col("node").alias("label"), F.col("label").alias("top"))
    labels = labels.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")).unionByName(
        over.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    )
    own, _ = materialize(nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label")), "node-labels")
    remove(spark, buckets_at, together_at, ranked_at, hubs_at, members_at, shared_at, texts_at, mixed_at, left_at, prints_at, sides_at, pairs_at)
    release_shuffles(spark)
    return table, own


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicates), class_size,
    kept (the one document of its class that stays)."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classes(docs).select("doc_id", "class_id", "class_size", (F.col("row_id") == F.col("class_row")).alias("kept"))
