"""Training and test samples, and multilingual test lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.text import draw
from glossa.operators.scorer import OUT_ROWS, tokenize
from glossa.session import ship_code, spread
from glossa.sources.files import exists, text_lines

SEPARATOR = ":::"


def samples(docs: DataFrame, least: int = 4, below: int = 8, seed: str = "samples") -> DataFrame:
    """(doc_id, lang, chunk, text, split): each document's words cut into
    samples of `least` to `below` - 1 words. The word after a full sample is
    dropped; a tenth of the full samples, and what is left at the end (maybe
    nothing), go to the test split. A document is a stream of its own and its
    samples are cut inside its row: no shuffle but of texts. md5 draws stand in
    for a random sequence (`draw` makes the same ones)."""
    ship_code(docs.sparkSession)

    def drawn(seed: str, key: str) -> int:
        return int.from_bytes(hashlib.md5(f"{seed}/{key}".encode()).digest()[:4], "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(2).is_valid())
            owner, number, texts, train = [], [], [], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                w, at, c, name = tokenize(text), 0, 0, "" if doc is None else f"{doc}/"
                while at <= len(w):
                    n = least + drawn(seed, f"{name}{c}") % (below - least)
                    owner.append(i)
                    number.append(c)
                    texts.append(" ".join(w[at : at + n]))
                    train.append(at + n < len(w) and drawn(f"{seed}-split", f"{name}{c}") % 10 > 0)
                    at, c = at + n + 1, c + 1
                if len(owner) >= OUT_ROWS or i == b.num_rows - 1:
                    at_ = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at_), b.column(1).take(at_), pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(["train" if x else "test" for x in train], pa.string())], names=["doc_id", "lang", "chunk", "text", "split"])
                    owner, number, texts, train = [], [], [], []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "lang", "text")).mapInArrow(run, f"doc_id {kind}, lang string, chunk int, text string, split string")


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split", "lang").parquet(path)


def take(rows: DataFrame, ratio: float = 0.0, first: int = 0, seed: str = "take") -> DataFrame:
    """A share `ratio` of the rows (0 or less: all), then the first few (0: all)."""
    if ratio > 0:
        rows = rows.where(draw(seed, F.col("doc_id"), F.col("chunk")) < int(ratio * (1 << 32)))
    return rows.orderBy("doc_id", "chunk").limit(first) if first > 0 else rows


def multilingual_lines(rows: DataFrame, limit: int = 30_000, seed: str = "multi") -> DataFrame:
    """(line_no, text, lang): up to `limit` test samples, languages mixed at
    random. Lines end when the samples do."""
    mixed = rows.where("split = 'test' AND text <> ''").select("text", "lang", draw(seed, F.col("doc_id"), F.col("chunk")).alias("r"), "doc_id", "chunk")
    # the `limit` first of each task, then of all
    chosen = mixed.orderBy("r", "doc_id", "chunk").limit(limit)
    return chosen.select((F.row_number().over(Window.orderBy("r", "doc_id", "chunk")) - 1).alias("line_no"), "text", "lang")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of (line_no, text, lang) as `text:::lang`, in order."""
    ordered = lines.orderBy("line_no").select(F.concat_ws(SEPARATOR, "text", F.coalesce("lang", F.lit(""))).alias("value"))
    ordered.write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, lang) of what `write_lines` wrote; lines without a language give
    null, lines without a separator are skipped."""
    part = F.split("value", SEPARATOR)
    lines = text_lines(spark, path).where(F.instr("value", SEPARATOR) > 0)
    return lines.select(F.trim(part[0]).alias("text"), F.nullif(F.element_at(part, -1), F.lit("")).alias("lang"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """What `write` wrote; nothing where nothing lies at `path`."""
    schema = "doc_id long, chunk int, text string, split string, lang string"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
