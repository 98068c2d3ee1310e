"""Language-model scoring with a log-bilinear neural model.

Tokens are words without A-Z case, then one end per text. Words with at least
the square root of the number of tokens, over `SPARSE`, occurrences (and
`LEAST`) predict and condition as themselves: the threshold grows with the
corpus, and so does the number of words above it. A rarer or unknown word
stands in the neural model for one of `FORMS` symbols by its last letters, and
within that symbol follows its smoothed count, with one share for the unknown.
glossa.llm.nce has the model of these symbols and its training, which takes
every training token once on the executors.

Every count comes from all training texts. The words above the threshold go to
the executors by broadcast; the counts of the others are joined by word, and as
each of these has a small share of the tokens, no task gets a hot one. Which
texts a task holds decides which updates are averaged, so `score` (not the
counts and `base_score`) depends slightly on the partitions.

Defined cases: null and empty texts are one end token; a null id counts as the
empty text in the fold and stays null in the result; repeated rows are scored
one by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import nce
from glossa.llm.common import fold, load, map_arrow, materialize, prepare, texts_of

LEAST, SPARSE = 5, 100
FORMS = 64
FIRST_WORD = FORMS + 1
FLUSH = 300_000
#: Learners of a part of the training for each core.
LEARNERS = 2


def form_symbol(word: bytes) -> int:
    """Symbol of a word that has none of its own, by its last letters."""
    return 1 + zlib.crc32(word[-2:]) % FORMS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; each task adds up what it holds first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in texts_of(b):
                seen.update(t.lower().split())
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return map_arrow(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The words with symbols of their own, from `FIRST_WORD` on, and their counts."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.at = {words[i]: k for k, i in enumerate(order)}
        self.counts = np.array([counts[i] for i in order], np.int64)
        self.forms = Forms()

    def code(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the words of texts: how many each has, the indices (-1: none), the
        symbols, and the words without an index."""
        split, found = [], [np.empty(0, np.int64)]
        for t in texts:  # a text's words are looked up while they are in the processor's cache
            split.append(words := t.lower().split())
            found.append(np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words)))
        sizes, ids = np.fromiter(map(len, split), np.int64, len(split)), np.concatenate(found)
        symbols = (ids + FIRST_WORD).astype(np.int32)
        cold = np.flatnonzero(ids < 0)
        words = list(chain.from_iterable(split))
        rest = [words[i] for i in cold.tolist()]
        symbols[cold] = np.fromiter(map(self.forms.__getitem__, [w[-2:] for w in rest]), np.int32, len(rest))
        return sizes, ids, symbols, rest


class Forms(dict):
    """Symbols by a word's last two bytes."""

    def __missing__(self, last: bytes) -> int:
        self[last] = form_symbol(last)
        return self[last]


def form_counts(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each form symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = np.zeros(FIRST_WORD, np.int64), np.zeros(FIRST_WORD, np.int64)
        for b in batches:
            c = np.array([form_symbol(w) for w in b.column(0).to_pylist()], np.int64)
            n += np.bincount(c, b.column(1).to_numpy(zero_copy_only=False), FIRST_WORD).astype(np.int64)
            d += np.bincount(c, minlength=FIRST_WORD)
        yield pa.RecordBatch.from_arrays([pa.array(range(FIRST_WORD), pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["c", "n", "d"])

    found = map_arrow(rare, run, "c int, n long, d long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toPandas()
    n, d = np.zeros(FIRST_WORD), np.zeros(FIRST_WORD)
    n[found["c"].to_numpy(int)], d[found["c"].to_numpy(int)] = found["n"].to_numpy(float), found["d"].to_numpy(float)
    return n, d


def train_words(training: DataFrame, lexicon, shape) -> np.ndarray:
    """Parameters after `nce.ROUNDS` parts of the training texts."""
    sc = training.sparkSession.sparkContext
    m = shape.value.start()
    for part in range(nce.ROUNDS):
        start = sc.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], part: int = part, start=start) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[np.ndarray]:
                for b in batches:
                    sizes, _, symbols, _ = lexicon.value.code(texts_of(b))
                    yield nce.contexts(symbols, sizes)

            task = TaskContext.get().partitionId()
            own = nce.Learner(shape.value, start.value, nce.RATES[part], task * nce.ROUNDS + part)
            own.learn(rows())
            yield from nce.pack(own.m - start.value, own.moved)

        own_part = F.pmod(F.xxhash64("text"), F.lit(nce.ROUNDS)) == part
        # few learners with many texts each: what they moved is added up afterwards
        texts = training.where(own_part).select("text").coalesce(LEARNERS * sc.defaultParallelism)
        moves = map_arrow(texts, run, "block int, payload binary")
        for r in map_arrow(moves.repartition("block"), nce.add_up, "block int, payload binary").toLocalIterator():
            nce.add_to(m, r.block, bytes(r.payload))
        start.unpersist()
    return m


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every
    text of `docs`, learning from the texts of `training`."""
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    ends = training.count()
    vocabulary, _ = materialize(word_counts(training), "lm-words")
    distinct, words = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, symbols = words + ends, distinct + (1 if ends else 0)
    hot_from = max(LEAST, math.isqrt(total) // SPARSE)
    hot = vocabulary.where(F.col("n") >= hot_from).toPandas()  # at most SPARSE times the square root of the tokens
    lex = Lexicon([bytes(w) for w in hot["word"]], hot["n"].tolist())
    lexicon = sc.broadcast(lex)
    n_forms, d_forms = form_counts(vocabulary.where(F.col("n") < hot_from))
    mass_log = np.log10(n_forms + 0.5 * (d_forms + 1))
    shape = sc.broadcast(nce.Shape(np.concatenate([[ends], n_forms[1:], lex.counts])))
    model = sc.broadcast(train_words(training, lexicon, shape))
    denominator, end_log = float(np.log10(total + 0.5 * (symbols + 1))), float(np.log10(ends + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hot_log = lexicon.value, np.log10(lexicon.value.counts + 0.5)
        normalised = nce.Scorer(shape.value, model.value)
        for b in batches:
            rows, n = b.column(b.schema.get_field_index("row_id")).to_numpy(), b.num_rows
            if not n:
                continue
            sizes, ids, symbols, rest = own.code(texts_of(b))
            owner, known = np.repeat(np.arange(n), sizes), ids >= 0
            cold = owner[~known]
            base = np.bincount(owner[known], hot_log[ids[known]], n) + end_log
            hot = np.bincount(owner[known], minlength=n) + (1 if ends else 0)
            by_token = normalised.log_probabilities(nce.contexts(symbols, sizes))
            scores = np.add.reduceat(by_token, np.cumsum(sizes + 1) - sizes - 1) - np.bincount(cold, mass_log[symbols[~known]], n)
            keys, tf, at = [], [], []
            edge = np.searchsorted(cold, np.arange(n + 1)).tolist()
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                seen = Counter(rest[x:y])
                keys += seen
                tf += seen.values()
                at.append(len(seen))
            for i in range(0, len(keys), 200_000):  # the cold words, then a row for each text
                part = slice(i, i + 200_000)
                own_rows = np.repeat(rows, at)[part]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.binary()), pa.array(own_rows, pa.int64()), pa.array(tf[part], pa.int64()), pa.nulls(len(own_rows), info_type)], schema=out_type)
            info = pa.StructArray.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(sizes + 1), pa.array(hot, pa.int64()), pa.array(base), pa.array(scores)],
                fields=list(info_type),
            )
            # no word has a space, so these keys meet no word and spread evenly
            yield pa.RecordBatch.from_arrays([pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), pa.array(rows, pa.int64()), pa.array(np.zeros(n, np.int64), pa.int64()), info], schema=out_type)

    info_type = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
    out_type = pa.schema([("word", pa.binary()), ("row_id", pa.int64()), ("tf", pa.int64()), ("info", info_type)])
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_id"))
    parts = map_arrow(rows_, run, "word binary, row_id long, tf long, info struct<doc_id:long,n_tokens:long,n_hot:long,base:double,model:double>")
    # no row is sorted: a part of the cold words is looked up in a table of its own,
    # and a row's columns are taken one by one, as structs are only grouped by sorting
    cold = vocabulary.where(F.col("n") < hot_from).hint("shuffle_hash")
    joined = parts.join(cold, "word", "left")
    summed = joined.groupBy("row_id").agg(
        *[F.max(f"info.{f.name}").alias(f.name) for f in info_type],
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("cold_log"),
    )
    return summed.select(
        "doc_id",
        "n_tokens",
        (F.col("n_hot") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.col("cold_log") - F.col("n_tokens") * F.lit(denominator), 9).alias("base_score"),
        F.round(F.col("model") + F.col("cold_log"), 9).alias("score"),
    )


def op1_log_bilinear_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = score_documents(docs, docs.where(fold("doc_id", 5) != 1))
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
