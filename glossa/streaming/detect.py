"""Language detection on streams: row-local, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators.scorer import scored


def detect_stream(rows: DataFrame, profiles: list) -> DataFrame:
    """All columns of a (streaming) frame but text, with lang_pred and score."""
    return scored(rows, profiles).drop("sims")


def counts_by_window(rows: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Languages counted in windows of event time, late rows dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "lang_pred").agg(F.count(F.lit(1)).alias("n"))


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def from_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
