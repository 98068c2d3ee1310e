"""Languages as a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, display name and order: fixed values.
LANGUAGES = [("en", "English", 0), ("fr", "French", 1), ("it", "Italian", 2), ("de", "German", 3), ("es", "Spanish", 4), ("pt", "Portuguese", 5)]


def languages(spark: SparkSession) -> DataFrame:
    """(lang, name, ord)."""
    return spark.createDataFrame(LANGUAGES, "lang string, name string, ord int")
