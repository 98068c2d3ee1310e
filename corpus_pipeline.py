"""The corpus pipeline: stages over `documents`, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut out of the texts, documents that hold benchmark items go, and
the rest is encoded. Each stage works on all that the one before it kept; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, decontaminate, neardup, substring, toxicity
from glossa.llm.common import load, materialize, prepare
from glossa.session import few_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM."""
    prepare(spark)
    model = toxicity.train(toxicity.learnable(docs), load(spark, sf_dir, "labels"))
    return toxicity.filtered(docs.select(*COLUMNS), model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words under repeated windows."""
    out = substring.without_repeats(docs.select(*COLUMNS), with_text=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each remaining document."""
    return bpe.encode_documents(docs)


def written(stage: Stage) -> Stage:
    """The stage's result in few files."""
    return lambda spark, docs, sf_dir: few_files(stage(spark, docs, sf_dir))


STAGES = [
    ("toxicity", written(drop_toxic)),
    ("near_duplicates", written(drop_near_duplicates)),
    ("substring_repeats", written(cut_repeats)),
    ("decontamination", written(drop_contaminated)),
    ("bpe", written(encode)),
]

#: The stages learn a model and verify similarities; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs
