"""Text files that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of UTF-8 text files; an empty frame where nothing lies at `path`."""
    return spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
