"""Scores of detectors and boundary detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    """(lang, total, errors, accuracy) of (lang, lang_pred), with a total row
    `*`; no prediction is an error."""
    wrong = (~F.col("lang").eqNullSafe(F.col("lang_pred"))).cast("long")
    out = rows.where("lang IS NOT NULL").rollup("lang").agg(F.count(F.lit(1)).alias("total"), F.sum(wrong).alias("errors"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), "total", "errors", F.round((F.col("total") - F.col("errors")) / F.col("total"), 6).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.where("lang IS NOT NULL").groupBy("lang", "lang_pred").agg(F.count(F.lit(1)).alias("n"))


def phrase_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Of the phrases found (text, lang) against the true ones (text, lang, seg),
    by exact text. The last true phrase does not count, and of equal true
    phrases the first one's language does; n_duplicates counts the others."""
    last = truth.agg(F.max("seg").alias("last"))
    own = truth.crossJoin(F.broadcast(last)).where("seg < last").groupBy("text").agg(F.min(F.struct("seg", "lang")).alias("first"), F.count(F.lit(1)).alias("times"))
    own = own.select("text", F.col("first.lang").alias("true_lang"), "times")
    n_true = own.agg(F.count(F.lit(1)).alias("n_true"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("n_duplicates"))
    own = own.drop("times")
    m = found.join(own, "text", "left").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.coalesce(F.sum(F.col("true_lang").isNull().cast("long")), F.lit(0)).alias("not_a_phrase"),
        F.coalesce(F.sum((F.col("true_lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("true_lang"))).cast("long")), F.lit(0)).alias("mis_tagged"),
        F.coalesce(F.sum(F.col("lang").eqNullSafe(F.col("true_lang")).cast("long") * F.col("true_lang").isNotNull().cast("long")), F.lit(0)).alias("correct"),
    )
    m = m.crossJoin(F.broadcast(n_true))
    recall, precision = F.try_divide(F.col("correct").cast("double"), F.col("n_true")), F.try_divide(F.col("correct").cast("double"), F.col("n_found"))
    f1 = F.try_divide(2 * recall * precision, recall + precision)
    return m.select("n_true", "n_duplicates", "n_found", "not_a_phrase", "mis_tagged", "correct", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def write_run(found: DataFrame, truth: DataFrame, path: str) -> None:
    """The found phrases and the expected ones, (seg, lang, text) each."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("seg").cast("long").alias("seg"), "lang", "text")
    part(found, "found").unionByName(part(truth, "expected")).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seg long, lang string, text string, kind string").parquet(path)
