"""Quality classifier: naive Bayes support vectors over shape n-grams.

Each word becomes a shape: runs of lower-case letters, of upper-case letters
and of digits shrink to one sign each, other signs stay as they are, and a word
equal to the one before it becomes a mark of its own. Features are indicators
of the text's 1-, 2- and 3-grams of shapes. They are scaled by the log ratio of
the smoothed class counts, and a linear hinge-loss model is fitted by dual
coordinate descent (Wang and Manning, 2012; Hsieh et al., 2008). A logistic
curve over the margins turns them into scores.

Fitting reads at most `MAX_LABELLED` labelled texts, drawn by a hash of the id,
of a repeated id the least text; every text is scored whole.

Defined cases: null and empty texts have no n-grams and get the intercept's
score; rows with a null id are scored and never fitted on; a null label is no
label; of contradicting labels the lower one counts; repeated rows are each
scored; with one class only, every score is that class's share; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import fold, load, map_arrow, materialize, prepare, remove, texts_of
from glossa.llm.sampling import drawn, frequencies, take_ids

MAX_LABELLED = 8_000
MIN_DOCS = 3
CACHE_WORDS = 100_000
LOWER, UPPER, DIGIT = re.compile(rb"[a-z]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")
AGAIN = np.uint64(0x9E3779B97F4A7C15)
P2, P3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class QualityModel:
    keys: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


def shape_of(word: bytes) -> int:
    """64-bit hash of a word's shape."""
    s = word.decode("utf-8", "replace")
    if not word.isascii():
        s = "".join("a" if c.islower() else "A" if c.isupper() else c for c in s)
    s = DIGIT.sub(b"0", UPPER.sub(b"A", LOWER.sub(b"a", s.encode())))
    return xxhash.xxh3_64_intdigest(s)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * P2
    return x ^ (x >> np.uint64(29))


def grams(text: bytes, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct features of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > CACHE_WORDS:
        memo.clear()
    try:
        one = np.array([memo[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in memo:
                memo[w] = shape_of(w)
        one = np.array([memo[w] for w in words], np.uint64)
    same = np.array([a == b for a, b in zip(words, words[1:], strict=False)], bool)
    if same.any():
        one[1:][same] ^= AGAIN
    two = mix(one[:-1] * P3 + one[1:])
    three = mix(two[:-1] * P3 + one[2:])
    return np.unique(np.concatenate([one, two, three]))


def feature_rows(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """doc_id, label and the distinct features of each text, if given those in
    the sorted `vocabulary` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in batches:
            rows = [np.sort(grams(t, memo).view(np.int64)) for t in texts_of(b)]
            if vocabulary is not None:
                rows = [np.intersect1d(r, vocabulary, assume_unique=True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("label")), pa.array(rows, pa.list_(pa.int64()))],
                names=["doc_id", "label", "features"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text"), run, "doc_id long, label int, features array<long>")


def fit_nbsvm(rows: list[np.ndarray], y: np.ndarray, cost: float = 0.1, epochs: int = 12, smooth: float = 1.0) -> QualityModel:
    """Dual coordinate descent for the L1-loss hinge on ratio-scaled indicators."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(np.empty(0, np.uint64), np.empty(0), 0.0, 0.0, float(np.log(p / (1 - p))))
    keys, df = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[df >= min(MIN_DOCS, len(rows))]
    own = []
    for r in rows:
        at = np.searchsorted(keys, r)
        own.append(at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == r)] if len(keys) else at[:0])
    flat, label = np.concatenate(own), np.repeat(y, [len(r) for r in own])
    p = smooth + np.bincount(flat[label == 1], minlength=len(keys))
    q = smooth + np.bincount(flat[label == 0], minlength=len(keys))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    sign = np.where(y == 1, 1.0, -1.0)
    # rows of unit length, so that long texts do not rule
    norm = np.array([np.sqrt((ratio[r] ** 2).sum()) or 1.0 for r in own])
    w, b, alpha = np.zeros(len(keys)), 0.0, np.zeros(len(own))
    rng, upper = np.random.default_rng(7), np.where(y == 1, cost / max(share, 1e-3), cost / max(1 - share, 1e-3))
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            r, s = own[i], sign[i]
            x = ratio[r] / norm[i]
            gradient = s * (w[r] @ x + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # x.x + 1 is 2
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * s * x
                b += (new - alpha[i]) * s
                alpha[i] = new
    margin = np.array([w[r] @ ratio[r] / n + b for r, n in zip(own, norm, strict=True)])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        z = 0.5 * (1 + np.tanh(0.5 * (slope * margin + offset)))
        g = np.array([((z - y) * margin).sum() + 1e-2 * slope, (z - y).sum()])
        h = z * (1 - z) + 1e-9
        step = np.linalg.solve(np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]]), g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return QualityModel(keys, np.stack([w * ratio, ratio**2]), float(b), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit from `docs` and `labels` (doc_id, quality); give only rows that may
    be learnt from."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id")
    spark = docs.sparkSession
    sample, sample_at = materialize(drawn(docs.select("doc_id", "text"), take_ids(known, MAX_LABELLED), "label"), "labelled")
    # only features that MIN_DOCS of the sample's texts have come here
    keys, _ = frequencies(feature_rows(sample), min(MIN_DOCS, max(1, sample.count())))
    rows = feature_rows(sample, keys).toPandas().sort_values("doc_id")  # at most MAX_LABELLED rows
    remove(spark, sample_at)
    return fit_nbsvm([np.asarray(x, np.int64).view(np.uint64) for x in rows.features], rows.label.to_numpy().astype(int))


def score(docs: DataFrame, model: QualityModel, keep: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        at = {int(k): i for i, k in enumerate(model.keys)}
        for b in batches:
            out = []
            for t in texts_of(b):
                r = [i for g in grams(t, memo).tolist() if (i := at.get(g)) is not None]
                margin = model.intercept
                if r:
                    margin += model.weights[0][r].sum() / (np.sqrt(model.weights[1][r].sum()) or 1.0)
                out.append(model.slope * margin + model.offset)
            s = 0.5 * (1 + np.tanh(0.5 * np.array(out, float)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(keep)), pa.array(s, pa.float64())], names=[keep, "score"])

    return map_arrow(docs.select(F.col(keep).cast("long").alias(keep), "text"), run, f"{keep} long, score double")


def op6_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0), load(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
