"""Bounded, deterministic samples of labelled and unlabelled rows for fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(doc_id: Column) -> Column:
    """A number that orders ids at random, the same for every run."""
    return F.md5(F.concat(F.lit("sample/"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def take_ids(ids: DataFrame, limit: int) -> DataFrame:
    """`limit` distinct ids with the lowest ranks, null ids never. Reads ids only."""
    own = ids.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return own.withColumn("_rank", rank_of(F.col("doc_id"))).orderBy("_rank", "doc_id").limit(limit).drop("_rank")


def drawn(docs: DataFrame, chosen: DataFrame, *rest: str) -> DataFrame:
    """One row of (doc_id, text) for each of the bounded ids `chosen`, with the
    columns `rest` of `chosen`; of repeated ids the least text."""
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *rest).agg(F.min("text").alias("text"))


def frequencies(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features that at least `least` rows have, and how many have them.
    Counted in Spark, so only the frequent ones of a bounded sample come here."""
    counted = rows.select(F.explode("features").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toPandas()
    counted = counted.sort_values("key")
    return counted.key.to_numpy(np.int64), counted.n.to_numpy(np.int64)
