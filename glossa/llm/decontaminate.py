"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

Texts are words without case, split at ASCII white space. An item of L words is
looked for in all windows of L words: both are multisets of `WORDS`-word
shingles, and a window leaks the item if their weighted Jaccard similarity
(sum of smaller counts over sum of larger counts) is `SIMILARITY` or more.

1. Windows. A window that reaches the similarity misses at most
   D = n - ceil(2 * 0.8 / 1.8 * n) of its n shingles, so one of its first D + 1
   and one of its last D + 1 shingles occur in some item of its length. Only
   windows with both are kept; none that could match is lost.
2. SimHash gives each window and item 64 bits, weighted by the counts.
3. Multi-index: of 64 bits cut into 6 blocks, two fingerprints within `RADIUS`
   = 17 have a block within 2 bits. Items enter the index with all such values
   of each block (402 rows an item), so all pairs within the radius are found,
   and of unlike fingerprints a fifth meet. At the least similarity the expected
   distance is 10 bits, and 17 is 2.6 standard deviations beyond; at 0.9 it is 5.
4. Candidates are verified by the exact similarity of the shingles themselves.

The item shingles are broadcast if there are at most `MAX_BROADCAST` of them,
else joined by shuffle. Texts go by the digest of their contents: copies are
looked through once, and no row number has to be the same in two scans.
Defined cases: null and empty texts and items match nothing; an item under five
words is one shingle; equal items are each reported; repeated rows are each
reported; null ids take part; empty tables give an empty result; extra columns
are not read, or kept by `clean`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import load, materialize, natively_split, release_shuffles, remove

WORDS, SIMILARITY = 5, 0.8
#: Bits of the blocks, from the lowest on.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS, BLOCK_RADIUS = 17, 2
MAX_BROADCAST = 500_000
SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def sizes(length: Column, similarity: float = SIMILARITY) -> tuple[Column, Column, Column]:
    """Words of a shingle, shingles of a window, and those it may miss, of a
    window of `length` words."""
    k = F.least(F.lit(WORDS), length)
    n = length - k + 1
    need = F.ceil(n * F.lit(2 * similarity / (1 + similarity)) - F.lit(1e-9))
    return k, n, (n - need).cast("int")


def shingle_rows(df: DataFrame, keys: list[str], words: str, length: Column) -> DataFrame:
    """`keys`, shingle and its count n, of windows whose words are in `words`."""
    k = F.least(F.lit(WORDS), length)
    each = df.select(*keys, F.col(words).alias("w"), k.alias("k"), F.explode(F.sequence(F.lit(1), length - k + 1)).alias("i"))
    return each.groupBy(*keys, F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("shingle")).agg(F.count(F.lit(1)).alias("n"))


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, 64-bit fingerprint and total weight of (keys, shingle, n) rows."""
    h = rows.withColumn("h", F.xxhash64("shingle"))
    bit = lambda b: F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(-F.col("n"))
    sums = h.groupBy(*keys).agg(*[F.sum(bit(b)).alias(f"b{b}") for b in range(64)], F.sum("n").alias("weight"))
    signs = F.array(*[(F.col(f"b{b}") > 0) for b in range(64)])
    value = F.aggregate(F.transform(signs, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return sums.select(*keys, value.alias("print"), "weight")


def block(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, sum(BLOCKS[:i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)).cast("int")


def near_values(bits: int) -> list[int]:
    """Differences of a block of so many bits within its radius."""
    return [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(bits), r)]


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each (row of
    `docs`, item) pair at or above `similarity`; `docs` has doc_id and text,
    `items` has item_id and text."""
    found = text_leaks(docs, items, similarity)
    return docs.select("doc_id", digest(F.col("text")).alias("text_key")).join(found, "text_key").drop("text_key")


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, that no item leaks into."""
    found, _ = materialize(text_leaks(docs.select("text"), items, similarity).select("text_key").distinct(), "leaking")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(F.col("text")).alias("text_key"))
    asked, others = natively_split(rows, "text_key", found, "leaking-bits")
    return others.unionByName(asked.join(found, "text_key", "left_anti")).select("row.*")


def text_leaks(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(text_key, item_id, start, similarity) of the distinct texts of `docs`."""
    spark = docs.sparkSession
    own = items.select(F.monotonically_increasing_id().alias("item"), "item_id", words_of(F.col("text")).alias("w")).withColumn("length", F.size("w")).where("length > 0")
    own, own_at = materialize(own, "items")
    k, n, miss = sizes(F.col("length"), similarity)
    marks = own.select("length", k.alias("k"), "w", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    marks = marks.select("length", "k", F.xxhash64(F.slice("w", F.col("i"), F.col("k"))).alias("mark")).distinct()
    marks, marks_at = materialize(marks, "marks")
    small = marks.count() <= MAX_BROADCAST
    texts = docs.select(digest(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("w"))
    hits = None
    for (width,) in marks.select("k").distinct().collect():  # at most WORDS rows
        at = texts.select("text_key", "w", F.size("w").alias("size")).where(F.col("size") >= width)
        at = at.select("text_key", "w", "size", F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("p"))
        at = at.select("text_key", "size", "p", F.xxhash64(F.array(*[F.get("w", F.col("p") + j) for j in range(width)])).alias("mark"))
        side = marks.where(F.col("k") == width).select("mark", "length")
        at = at.join(F.broadcast(side) if small else side, "mark").select("text_key", "size", "p", "length")
        hits = at if hits is None else hits.unionByName(at)
    if hits is None:
        hits = spark.createDataFrame([], "text_key string, size int, p int, length int")
    hits, hits_at = materialize(hits, "hits")
    k, n, miss = sizes(F.col("length"), similarity)
    early = hits.select("text_key", "length", "size", F.explode(F.sequence(F.col("p") - miss, F.col("p"))).alias("start"), F.lit(1).alias("e"), F.lit(0).alias("l"))
    late = hits.select("text_key", "length", "size", F.explode(F.sequence(F.col("p") - n + 1, F.col("p") - n + 1 + miss)).alias("start"), F.lit(0).alias("e"), F.lit(1).alias("l"))
    both = early.unionByName(late).where("start >= 0 and start + length <= size").groupBy("text_key", "length", "start").agg(F.max("e").alias("e"), F.max("l").alias("l")).where("e = 1 and l = 1")
    starts, starts_at = materialize(both.groupBy("text_key").agg(F.collect_list(F.struct("start", "length")).alias("windows")), "starts")
    # a filter of bounded size keeps all other texts out of the join's shuffle
    asked, _ = natively_split(docs.select(digest(F.col("text")).alias("text_key"), "text"), "text_key", starts.select("text_key"), "starts-bits")
    window = asked.join(starts, "text_key").dropDuplicates(["text_key"]).select("text_key", words_of(F.col("text")).alias("w"), "windows")
    window = window.select("text_key", "w", F.explode("windows").alias("x"))
    window = window.select("text_key", F.col("x.start").alias("start"), F.col("x.length").alias("length"), F.slice("w", F.col("x.start") + 1, F.col("x.length")).alias("w"))
    window = window.withColumn("text_hash", F.md5(F.array_join("w", " ").cast("binary")))
    window, window_at = materialize(window, "windows")
    release_shuffles(spark)
    # equal windows are handled once
    texts_of = window.groupBy("text_hash").agg(F.first("w").alias("w"), F.first("length").alias("length"))
    seen, seen_at = materialize(shingle_rows(texts_of, ["text_hash", "length"], "w", F.col("length")), "shingles")
    known, known_at = materialize(shingle_rows(own, ["item", "length"], "w", F.col("length")), "shingles")
    prints, marked = simhash(seen, ["text_hash", "length"]), simhash(known, ["item", "length"])
    blocks = F.posexplode(F.array(*[block(F.col("print"), i) for i in range(len(BLOCKS))])).alias("b", "v")
    index = marked.select("item", "length", F.col("print").alias("item_print"), F.col("weight").alias("item_weight"), blocks)
    near = F.array(*[F.lit(near_values(n)) for n in BLOCKS])
    index = index.withColumn("x", F.explode(F.get(near, F.col("b")))).withColumn("v", F.col("v").bitwiseXOR(F.col("x"))).drop("x")
    found = prints.select("text_hash", "length", "print", "weight", blocks).join(index, ["length", "b", "v"])
    found = found.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("text_hash", "item", "weight", "item_weight").distinct()
    common = found.join(seen.select("text_hash", "shingle", F.col("n").alias("n1")), "text_hash").join(known.select("item", "shingle", F.col("n").alias("n2")), ["item", "shingle"])
    common = common.groupBy("text_hash", "item", "weight", "item_weight").agg(F.sum(F.least("n1", "n2")).alias("least"))
    common = common.withColumn("similarity", F.col("least") / (F.col("weight") + F.col("item_weight") - F.col("least"))).where(F.col("similarity") >= similarity - 1e-12)
    best = window.select("text_key", "start", "text_hash").join(common.select("text_hash", "item", "similarity"), "text_hash")
    best = best.groupBy("text_key", "item").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("minus"))).alias("best"))
    best = best.join(own.select("item", "item_id"), "item")
    out, _ = materialize(best.select("text_key", "item_id", (-F.col("best.minus")).alias("start"), F.col("best.similarity").alias("similarity")), "leaks")
    remove(spark, own_at, marks_at, hits_at, starts_at, window_at, seen_at, known_at)
    release_shuffles(spark)
    return out


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that leaks into it."""
    return leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
