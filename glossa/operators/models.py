"""Language profiles: training, text format, and the Python form for scoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.text import SIZES, ngrams, tokenize, top_k, word_weight
from glossa.operators.scorer import OUT_ROWS
from glossa.operators.scorer import tokenize as tokenize_row
from glossa.session import ship_code, spread
from glossa.sources.files import exists


def word_table(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, count) of a text column."""
    return texts.select(*keys, F.explode(tokenize(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))


def ngram_dimension(words: DataFrame) -> DataFrame:
    """(word, n, ngram): n-grams once for each distinct word."""
    sized = words.select("word").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES])))
    return sized.select("word", "n", F.explode(ngrams(F.col("word"), F.col("n"))).alias("ngram"))


def frequencies(words: DataFrame, keys: list[str], adjust: bool) -> DataFrame:
    """(keys, n, ngram, freq) of (keys, word, count); with `adjust` a word counts
    one through its length."""
    value = F.col("count") * (word_weight(F.col("word")) if adjust else F.lit(1.0))
    return words.join(ngram_dimension(words), "word").groupBy(*keys, "n", "ngram").agg(F.sum(value).alias("freq"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, n, ngram, freq) of (lang, text), added up within a task for some
    MAX_WORDS distinct words at a time: add the rows of an n-gram up. Words are
    counted first, so n-grams are made once for each of these."""
    from glossa.operators import lexicon as lex

    ship_code(docs.sparkSession)

    def counted(own: lex.Lexicon, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        own.clear()
        for lang, words in counts.items():
            ids = own.ids(list(words))
            sizes = own.sizes.rows[ids].sum(1)
            number = own.number.rows[lex.ragged(own.start.rows[ids], sizes)]
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
            order = np.argsort(number)
            first = lex.first_of_runs(number[order])
            freq = np.add.reduceat(times[order], first) if len(first) else times
            number = number[order][first]
            for i in range(0, len(number), OUT_ROWS):
                part = number[i : i + OUT_ROWS]
                grams = pa.array([own.grams[k] for k in (part & (1 << lex.GRAM_BITS) - 1).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part >> lex.GRAM_BITS, pa.int32()), grams, pa.array(freq[i : i + OUT_ROWS])], names=["lang", "n", "ngram", "freq"])
        own.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.Lexicon(texts=True)
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(tokenize_row(text or ""))
                if sum(map(len, counts.values())) > lex.MAX_WORDS:
                    yield from counted(own, counts)
                    counts = {}
        yield from counted(own, counts)

    return spread(docs.select("lang", "text")).mapInArrow(run, "lang string, n int, ngram string, freq long")


def train(docs: DataFrame) -> DataFrame:
    """(lang, n, ngram, weight, rnk) from (lang, text): the commonest n-grams of
    each language and size, frequency over norm with three decimals. Profiles
    are at most 151 rows each; ranking runs per (lang, n) on aggregated rows,
    with a limit that Spark applies before it shuffles."""
    grams = gram_counts(docs.where("lang IS NOT NULL"))
    freq = grams.groupBy("lang", "n", "ngram").agg(F.sum("freq").cast("double").alias("freq"))
    ranked = freq.withColumn("rnk", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("freq"), F.desc("ngram"))))
    top = ranked.where("rnk <= 151").where(F.col("rnk") <= top_k(F.col("n")))
    norm = F.sqrt(F.sum(F.col("freq") * F.col("freq")).over(Window.partitionBy("lang", "n")))
    return top.select("lang", "n", "ngram", F.round(F.col("freq") / norm, 3).alias("weight"), "rnk")


def to_lines(model: DataFrame) -> DataFrame:
    """(lang, n, rnk, line): the text form, `ngram:weight`."""
    return model.select("lang", "n", "rnk", F.concat_ws(":", "ngram", F.format_number("weight", 3)).alias("line"))


def write(model: DataFrame, path: str) -> None:
    """A folder for each language and size, lines in rank order."""
    lines = to_lines(model).repartition("lang", "n").sortWithinPartitions("lang", "n", "rnk")
    lines.select("lang", "n", F.col("line").alias("value")).write.mode("overwrite").partitionBy("lang", "n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What `write` wrote; lines without a separator are skipped, and nothing
    comes where nothing lies at `path`."""
    if not exists(spark, path):
        return spark.createDataFrame([], "lang string, n int, ngram string, weight double")
    lines = spark.read.schema("value string, lang string, n int").text(path).where(F.instr("value", ":") > 0)
    return lines.select("lang", "n", F.regexp_extract("value", r"^(.*):[^:]*$", 1).alias("ngram"), F.regexp_extract("value", r":([^:]*)$", 1).cast("double").alias("weight"))
