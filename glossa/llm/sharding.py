"""Rendezvous (highest-random-weight) sharding of stable record keys.

Each key draws one uniform number per shard from md5(key/shard) and goes to the
shard with the largest ``-weight / ln(u)``. Only key, weights and shard count
decide, so one more shard takes rows only into itself.

Defined cases: a null key is the empty key; a null text has 0 bytes and CRC 0;
repeated rows share a shard and get different slots; an empty table gives an
empty result; equal scores go to the lower shard; other columns of the input
stay as they are, whatever their names, or are not read. Slots follow row
numbers that are written once, so a lost executor changes none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import load, numbered

#: Rows of one block when slots are dealt: bounds the largest window.
BLOCK_BITS = 14


def draw(key: Column, shard: int, weight: float) -> Column:
    """The key's score for one shard, larger wins."""
    h = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winning shard; ties go to the lower number."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct(draw(text, i, w).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights) if w > 0]
    best = F.array_max(F.array(*scores))
    return F.struct(best["score"].alias("score"), (-best["minus"]).alias("shard"))


def with_slots(df: DataFrame, shard: str, slot: str) -> DataFrame:
    """Number the rows of each shard from 0 without a gap. Rows are numbered in
    blocks of at most 2^BLOCK_BITS consecutive written rows; the blocks' counts
    give the offsets, so no task holds a shard."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{shard}`").alias("shard"))
    rows, _ = numbered(own, "sharded")
    rows = rows.withColumn("block", F.shiftright("row_id", BLOCK_BITS))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("row_id")
    placed = rows.withColumn("place", F.row_number().over(within) - 1)
    joined = placed.join(offsets, placed["shard"].eqNullSafe(offsets["shard"]) & (placed["block"] == offsets["block"]))
    return joined.select("row.*", (F.col("offset") + F.col("place")).cast("long").alias(slot))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """`documents` over `shards` equal shards under the law ``key``."""
    docs = load(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * shards).alias("_won"),
        draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), shards, 1.0).alias("_new"),
    )
    rows = rows.withColumn("shard", F.col("_won.shard").cast("int"))
    rows = rows.withColumn("grown_shard", F.when(F.col("_new") > F.col("_won.score"), F.lit(shards)).otherwise(F.col("shard")).cast("int")).drop("_won", "_new")
    return with_slots(rows, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
