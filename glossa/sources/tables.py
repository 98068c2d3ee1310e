"""Texts as rows of (id, text), and language profiles learnt from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import models
from glossa.operators.scorer import profiles_of
from glossa.session import load


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.train(corpus(spark, sf_dir))


_LEARNT: dict[tuple[str, str], list[tuple[str, int, str, float]]] = {}


def profiles(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, str, float]]:
    """The profiles of the documents below `sf_dir`, at most 907 rows for each
    language, learnt once in an application. `forget` drops them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEARNT:
        _LEARNT[key] = profiles_of(model(spark, sf_dir))
    return _LEARNT[key]


def forget() -> None:
    _LEARNT.clear()
