"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words, of word beginnings and of
beginnings that two words share is fitted in numpy from
confirmed toxic examples and unlabelled text by minimising the class-prior
corrected risk

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

with the logistic loss; where the bracket is negative the step follows its
negative gradient instead (Kiryo et al., 2017). An L1 proximal step keeps only
features that carry signal, so that long clean texts do not add up noise. The
prior is the share of toxic rows among the labelled ones, between 0.001 and 0.5.

Every text that may be learnt from is unlabelled text: how many have a feature
is counted over all of them, and so is R_unl with its gradient. For this, texts
become lists of the features that can tell toxic texts apart, and each of the
`STEPS` steps sums loss and gradient over the written lists on the executors.
The toxic examples, of which at most `MAX_POSITIVE` are drawn by a hash of the
id, and the weights are on the driver.

Defined cases: null and empty texts have no words and get the bias's score;
rows with a null id are scored and are unlabelled text, never an example; a null
label is no label; of contradicting labels the toxic one counts; repeated rows
are each scored; without toxic examples every score is the prior's; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from glossa.llm.common import fold, load, map_arrow, materialize, prepare, remove, texts_of
from glossa.llm.sampling import drawn, take_ids

MAX_POSITIVE = 2_000
STEPS, RATE, L1 = 80, 0.3, 2e-4
#: Tasks of a step.
PARTS = 16
#: A feature must occur in so many of the toxic examples.
MIN_POSITIVE_DOCS = 4
#: Characters of the word beginnings that count as features.
PREFIXES = range(4, 9)
EDGES = ".,;:!?*$%&#|<>()[]{}\"'-_=+/\\~`"
CACHE_WORDS = 300_000


@dataclass
class ToxicModel:
    keys: list[str]
    weights: np.ndarray
    bias: float
    prior: float


def plain(raw: bytes) -> str:
    """A word without case and edge punctuation."""
    return raw.decode("utf-8", "replace").lower().strip(EDGES)


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) >= n]


def features_of(words: set[bytes]) -> set[str]:
    """A text's features: its words (w), the beginnings of its words (p), and
    the beginnings that at least two different words share (t)."""
    own = {plain(w) for w in words}
    seen = Counter(p for w in own for p in beginnings(w))
    return {"w" + w for w in own} | {"p" + p for p in seen} | {"t" + p for p, n in seen.items() if n > 1}


def feature_rows(docs: DataFrame) -> DataFrame:
    """The distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts_of(b):  # a text at a time: its features are some times its size
                yield pa.RecordBatch.from_arrays([pa.array([sorted(features_of(set(t.split())))], pa.list_(pa.string()))], names=["features"])

    return map_arrow(docs.select("text"), run, "features array<string>")


class Known:
    """The features of texts among given ones, by their indices. Words are
    looked up in a bounded memo; the rest is done for all texts of a batch at once."""

    def __init__(self, keys: list[str]) -> None:
        self.at: dict[str, dict[str, int]] = {kind: {} for kind in "wpt"}
        for i, k in enumerate(keys):
            self.at[k[0]][k[1:]] = i
        self.begin = self.at["p"].keys() | self.at["t"].keys()
        self.heads = {w[:4].encode() for w in self.begin | self.at["w"].keys()}
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}  # number of a word without case and edges, -1: no known feature
        self.number: dict[str, int] = {}
        self.codes: dict[str, int] = {}  # of the beginnings
        self.own: list[int] = []
        self.begins: list[list[int]] = []
        self.once: list[int] = []
        self.twice: list[int] = []

    def learn(self, raw: bytes) -> None:
        head = raw[:4]
        if len(head) == 4 and head.isalnum() and head.lower() not in self.heads:  # most words, quickly
            self.memo[raw] = -1
            return
        word, begin = plain(raw), self.begin
        parts = [p for n in PREFIXES if len(word) >= n and (p := word[:n]) in begin]
        if not parts and word not in self.at["w"]:
            self.memo[raw] = -1
            return
        if word not in self.number:
            self.number[word] = len(self.own)
            self.own.append(self.at["w"].get(word, -1))
            for p in parts:
                if p not in self.codes:
                    self.codes[p] = len(self.once)
                    self.once.append(self.at["p"].get(p, -1))
                    self.twice.append(self.at["t"].get(p, -1))
            self.begins.append([self.codes[p] for p in parts])
        self.memo[raw] = self.number[word]

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all distinct pairs, by text."""
        if len(self.memo) > CACHE_WORDS:
            self.forget()
        memo, split = self.memo, [t.split() for t in texts]
        try:
            ids = np.array([memo[w] for ws in split for w in ws], np.int64)
        except KeyError:
            for ws in split:
                for w in ws:
                    if w not in memo:
                        self.learn(w)
            ids = np.array([memo[w] for ws in split for w in ws], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])[ids >= 0]
        n = max(len(self.own), 1)
        o, w = np.divmod(np.unique(owner * n + ids[ids >= 0]), n)
        used, at = np.unique(w, return_inverse=True)  # what the words of the batch have
        begins = [self.begins[i] for i in used.tolist()]
        sizes = np.array([len(x) for x in begins], np.int64)
        flat = np.array([c for x in begins for c in x], np.int64)
        start, count = (np.cumsum(sizes) - sizes)[at], sizes[at]
        place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        m = max(len(self.once), 1)
        found, times = np.unique(np.repeat(o, count) * m + flat[place], return_counts=True)
        po, code = np.divmod(found, m)
        own, once, twice = np.array(self.own, np.int64)[w], np.array(self.once, np.int64)[code], np.where(times > 1, np.array(self.twice, np.int64)[code], -1)
        texts_, features = np.concatenate([o, po, po]), np.concatenate([own, once, twice])
        texts_, features = texts_[features >= 0], features[features >= 0]
        order = np.argsort(texts_, kind="stable")
        return texts_[order], features[order]


def texts_with(docs: DataFrame, keys: list[str]) -> np.ndarray:
    """In how many texts of `docs` each feature occurs."""
    given = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Known(given.value), np.zeros(len(given.value), np.int64)
        for b in batches:
            n += np.bincount(known.pairs(texts_of(b))[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["key", "n"])

    found = map_arrow(docs.select("text"), run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys), np.int64)
    out[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def feature_lists(docs: DataFrame, keys: list[str]) -> DataFrame:
    """`docs` with `features`, each text's indices into `keys`, for its text."""
    given = docs.sparkSession.sparkContext.broadcast(keys)
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(given.value)
        for b in batches:
            owner, features = known.pairs(texts_of(b))
            offsets = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), lists], names=[*(f.name for f in rest), "features"])

    return map_arrow(docs, run, StructType([*rest, StructField("features", ArrayType(IntegerType()))]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def negative_risk(lists: DataFrame, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The summed loss of calling every text of `lists` clean, and its gradient
    by the weights and the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 2)
        for b in batches:
            col = b.column(0)
            at = col.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
            f = np.bincount(owner, w[at], len(col)) + bias
            s = sigmoid(f)
            total[:-2] += np.bincount(at, s[owner], len(w))
            total[-2:] += s.sum(), np.logaddexp(0, f).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = lists.mapInArrow(run, "sums binary").collect()  # PARTS rows at most
    total = np.sum(np.stack([np.frombuffer(bytes(r[0])) for r in found]), 0) if found else np.zeros(len(w) + 2)
    return float(total[-1]), total[:-1]


def fit_nnpu(pos: list[np.ndarray], keys: list[str], unlabelled: Callable[[np.ndarray, float], tuple[float, np.ndarray]], n_unl: int, prior: float) -> ToxicModel:
    """Adam on the non-negative risk; `pos` has each toxic example's indices
    into `keys`, `unlabelled` gives the summed loss and gradient of the other texts."""
    if not pos or not n_unl:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicModel([], np.empty(0), float(np.log(p / (1 - p))), prior)
    k = len(keys)
    po, pc = np.repeat(np.arange(len(pos)), [len(r) for r in pos]), np.concatenate(pos).astype(np.int64)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):
        fp = np.bincount(po, w[pc], len(pos)) + bias
        loss, gu = unlabelled(w, bias)
        sp = sigmoid(fp)
        if loss / n_unl - prior * np.logaddexp(0, fp).mean() >= 0:
            gp, gu = prior * (sp - 1) / len(pos) - prior * sp / len(pos), gu / n_unl
        else:
            gp, gu = prior * sp / len(pos), -gu / n_unl
        g = np.append(np.bincount(pc, gp[po], k), gp.sum()) + gu
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1)))
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-8
        step = rate * (m / (1 - 0.9**t)) / scale
        w, bias = w - step[:k], bias - step[k]
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * rate / scale[:k], 0)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return ToxicModel([keys[i] for i in keep.tolist()], w[keep], float(bias), prior)


def fit(docs: DataFrame, labels: DataFrame, may: Column) -> tuple[ToxicModel, DataFrame | None, np.ndarray]:
    """A model from the rows of `docs` that it `may` be learnt from and the toxic
    rows of `labels` (doc_id, toxic). With it, where there is a toxic example,
    (doc_id, features) of all rows as written, and the features' weights."""
    docs, spark = docs.select("doc_id", "text", may.alias("may")), docs.sparkSession
    own = docs.where("may")
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(own.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id")
    n, n_pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max((n_pos + 0.5) / (n + 1.0), 1e-3), 0.5)
    pos, pos_at = materialize(drawn(own.select("doc_id", "text"), take_ids(known.where("toxic = 1").select("doc_id"), MAX_POSITIVE)), "positive")
    sizes = pos.count(), own.count()
    if not all(sizes):
        remove(spark, pos_at)
        return fit_nnpu([], [], lambda w, bias: (0.0, w), 0, prior), None, np.empty(0)
    least = min(MIN_POSITIVE_DOCS, max(1, sizes[0] // 4))
    counted = feature_rows(pos).select(F.explode("features").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toPandas()
    counted = counted.sort_values("key")
    keys, df = counted["key"].tolist(), counted["n"].to_numpy(np.int64)
    # what is no commoner in toxic texts than in others can't tell them apart
    telling = np.flatnonzero((df / sizes[0]) > 2.0 * (texts_with(own, keys) + 1) / (sizes[1] + 1))
    keys = [keys[i] for i in telling.tolist()]
    examples = [np.asarray(x, np.int64) for x in sorted(r[0] for r in feature_lists(pos.select("text"), keys).collect())]  # at most MAX_POSITIVE rows
    lists, _ = materialize(feature_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "may", "text"), keys), "lists")
    unlabelled = lists.where("may").select("features").coalesce(PARTS)
    model = fit_nnpu(examples, keys, lambda w, bias: negative_risk(unlabelled, w, bias), sizes[1], prior)
    remove(spark, pos_at)
    of = dict(zip(model.keys, model.weights.tolist(), strict=True))
    return model, lists.select("doc_id", "features"), np.array([of.get(k, 0.0) for k in keys])


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model of `docs`, all of which may be learnt from."""
    return fit(docs, labels, F.lit(True))[0]


def score_lists(lists: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """The score of every row of (doc_id, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            owner = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
            raw = np.bincount(owner, weights[col.flatten().to_numpy(zero_copy_only=False)], len(col)) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(sigmoid(raw), 9))], names=["doc_id", "score"])

    return map_arrow(lists, run, "doc_id long, score double")


class Scorer:
    """Scores texts one by one."""

    def __init__(self, model: ToxicModel) -> None:
        self.known, self.weights, self.bias = Known(model.keys), model.weights, model.bias

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        owner, features = self.known.pairs(texts)
        return np.round(sigmoid(np.bincount(owner, self.weights[features], len(texts)) + self.bias), 9)


def score(docs: DataFrame, model: ToxicModel, keep: str = "doc_id") -> DataFrame:
    """`keep` (a long column) and the score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(keep)), pa.array(scorer(texts_of(b)), pa.float64())], names=[keep, "score"])

    return map_arrow(docs.select(F.col(keep).cast("long").alias(keep), "text"), run, f"{keep} long, score double")


def filtered(docs: DataFrame, model: ToxicModel, below: float) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores less than `below`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array(scorer(texts_of(b)) < below))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def op5_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    model, lists, weights = fit(docs, load(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    out = score(docs, model) if lists is None else score_lists(lists, weights, model.bias)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
