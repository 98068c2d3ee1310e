"""One-vs-rest classifiers over similarity features: bagged ID3 trees and
logistic regression.

Features are ordered LINEAR, 1 to 6; a tree looks at its own language's value
of each, the logistic model at all languages' values.
"""

from __future__ import annotations

import json
import socket
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.text import SIZES, bin_of, dot, draw, entropy, sigmoid
from glossa.operators.detect import cell, parts
from glossa.session import materialize, remove
from glossa.sources.files import exists

FEATURES = ["LINEAR", "1", "2", "3", "4", "5", "6"]
BAGS = 10
RATE, LEAST_ROUNDS, MOST_ROUNDS, SMALL_SUM, SMALL_ERROR = 10.0, 10, 20, 1.0, 1e-6
#: Rows that a task of the logistic trainer holds at least, if there are more tasks than one.
ROWS_PER_TASK = 20_000
#: Parts of 1 that gradients are added up in, and seconds that a task waits for another.
UNIT, PATIENCE_S = float(1 << 36), 600
BINS = [f"b{i}" for i in range(7)]


def feature_rows(scored: DataFrame, key: str, langs: list[str], *keep: str) -> DataFrame:
    """(id, lang, f0..f6): each text's features for each language, made inside
    the scorer's rows; with the columns `keep`."""
    sims, n = F.col("sims"), len(langs)
    each = [F.struct(F.lit(lang).alias("lang"), F.round(total, 9).alias("f0"), *[F.round(cell(sims, k, i, n), 9).alias(f"f{k}") for k in SIZES]) for i, (lang, total) in enumerate(zip(langs, parts(sims, n, False), strict=True))]
    return scored.select(F.col(key).alias("id"), *keep, F.explode(F.array(*each)).alias("c")).select("id", *keep, "c.*")


def binned(features: DataFrame) -> DataFrame:
    """(id, lang, positive, b0..b6) of features with their `truth`: a row for
    each text and one-vs-rest task."""
    return features.select(
        "id", "lang", F.coalesce((F.col("lang") == F.col("truth")).cast("long"), F.lit(0)).alias("positive"), *[bin_of(F.col(f"f{i}")).alias(f"b{i}") for i in range(7)]
    )


def bags(rows: DataFrame, n: int = BAGS, seed: str = "bag") -> DataFrame:
    """Each row `w` times in each of `n` bags, w by a Poisson draw of mean 1:
    drawing with replacement without knowing the number of rows. Rows with a w of
    0 are left to `id3`: a filter here would make the draw for each of its terms."""
    u = (draw(seed, F.col("bag"), F.col("lang"), F.col("id")) + 0.5) / float(1 << 32)
    w, p, upto = F.lit(0), np.exp(-1.0), 0.0
    for k in range(1, 8):
        upto += p
        p /= k
        w = w + (u > upto).cast("int")
    return rows.withColumn("bag", F.explode(F.array(*[F.lit(i) for i in range(n)]))).withColumn("w", w.cast("long"))


def gains(rows: DataFrame) -> DataFrame:
    """(bag, lang, node, feature, gain): of each feature left at each node of
    (bag, lang, node, w, positive, b0..b6)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in range(7)])).alias("c")
    counts = rows.select("bag", "lang", "node", "used", "w", "positive", cells).where(~F.array_contains("used", F.col("c.feature")))
    counts = counts.groupBy("bag", "lang", "node", "c.feature", "c.bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("positive")).alias("p"))
    by_feature = counts.groupBy("bag", "lang", "node", "feature").agg(F.sum("n").alias("total"), F.sum("p").alias("pos"), F.sum(F.col("n") * entropy(F.col("p"), F.col("n"))).alias("rest"))
    return by_feature.select("bag", "lang", "node", "feature", F.round(entropy(F.col("pos"), F.col("total")) - F.col("rest") / F.col("total"), 9).alias("gain"))


def id3(rows: DataFrame) -> DataFrame:
    """(bag, lang, node, feature, confidence, n) of the trees grown from (bag,
    lang, w, positive, b0..b6). A node is named by its path, `feature:bin/...`;
    a leaf has no feature. Nodes split on the largest gain (first feature on
    ties) until pure or out of features, at most seven levels, each of which is
    one aggregation; the pure nodes' rows leave the table. Equal rows are added up
    first: a tree sees nothing of a row but its bins."""
    equal = rows.groupBy("bag", "lang", "positive", *BINS).agg(F.sum("w").alias("w")).where("w > 0")
    live = equal.withColumn("node", F.lit("")).withColumn("used", F.array().cast("array<int>"))
    out, old = None, []
    for level in range(8):
        # a level reads its rows three times: write them, and drop the last level's
        live, live_at = materialize(live, "level")
        remove(live.sparkSession, *old)
        old = [live_at]
        nodes = live.groupBy("bag", "lang", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("positive")).alias("p"))
        nodes = nodes.withColumn("confidence", F.round(F.col("p") / F.col("n"), 9))
        if level < 7:
            best = Window.partitionBy("bag", "lang", "node").orderBy(F.desc("gain"), "feature")
            split = gains(live).withColumn("k", F.row_number().over(best)).where("k = 1").select("bag", "lang", "node", "feature")
            nodes = nodes.join(split, ["bag", "lang", "node"], "left").withColumn("feature", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("feature")))
        else:
            nodes = nodes.withColumn("feature", F.lit(None).cast("int"))
        part, _ = materialize(nodes.select("bag", "lang", "node", "feature", "confidence", "n"), "nodes")
        out = part if out is None else out.unionByName(part)
        if level < 7:
            going = part.where("feature IS NOT NULL").select("bag", "lang", "node", "feature")
            if not going.limit(1).count():
                break
            live = live.join(going, ["bag", "lang", "node"]).withColumn("bin", F.element_at(F.array(*[F.col(f"b{i}") for i in range(7)]), F.col("feature") + 1))
            live = live.withColumn("node", F.concat("node", F.col("feature").cast("string"), F.lit(":"), F.col("bin").cast("string"), F.lit("/"))).withColumn("used", F.concat("used", F.array("feature"))).drop("bin", "feature")
    remove(out.sparkSession, *old)
    return out


def predict_trees(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(id, lang, confidence): the mean over the bags of the leaf that each row
    of (id, lang, b0..b6) reaches; 0.5 where no branch fits. Equal rows go the way
    down once."""
    bag_ids = trees.select("bag").distinct()
    distinct = materialize(rows.select("lang", *BINS).distinct(), "distinct")[0]
    at = distinct.crossJoin(F.broadcast(bag_ids)).withColumn("node", F.lit(""))
    done = None
    for _ in range(8):
        met = at.join(trees.select("bag", "lang", "node", "feature", F.col("confidence").alias("c")), ["bag", "lang", "node"], "left")
        met, _ = materialize(met, "met")
        end = met.where("feature IS NULL").select("lang", *BINS, "bag", F.coalesce("c", F.lit(0.5)).alias("c"))
        done = end if done is None else done.unionByName(end)
        at = met.where("feature IS NOT NULL").withColumn("bin", F.element_at(F.array(*[F.col(f"b{i}") for i in range(7)]), F.col("feature") + 1))
        at = at.withColumn("node", F.concat("node", F.col("feature").cast("string"), F.lit(":"), F.col("bin").cast("string"), F.lit("/"))).drop("feature", "c", "bin")
        if not met.where("feature IS NOT NULL").limit(1).count():
            break
    found = done.groupBy("lang", *BINS).agg(F.round(F.avg("c"), 9).alias("confidence"))
    return rows.join(found, ["lang", *BINS]).select("id", "lang", "confidence")


def print_tree(trees: DataFrame) -> DataFrame:
    """(bag, lang, node, line): readable lines; a line has the range that leads
    to its node, then the node's feature or its confidence and size."""
    path = F.split("node", "/")
    step = F.split(F.element_at(path, -2), ":")  # the last part is empty
    edges = F.array(*[F.lit(f"{k / 10:.1f}") for k in range(11)])
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), step[0].cast("int") + 1)
    k = step[1].cast("int")
    low, high = F.when(k > 0, F.concat(F.get(edges, k - 1), F.lit(" <= "))).otherwise(""), F.when(k < 11, F.concat(F.lit(" < "), F.get(edges, k))).otherwise("")
    branch = F.when(F.size(path) > 1, F.concat(low, name, high, F.lit(": "))).otherwise("")
    own = F.when(F.col("feature").isNull(), F.concat(F.lit("confidence = "), F.format_number("confidence", 3), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("split on "), F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature") + 1))
    )
    return trees.select("bag", "lang", "node", F.concat(F.repeat(F.lit("  "), F.size(path) - 1), branch, own).alias("line"))


def vectors(scored: DataFrame, key: str, langs: list[str], *keep: str) -> DataFrame:
    """(id, x): all languages' values, feature by feature; with the columns `keep`."""
    first = F.array(*[F.round(p, 9) for p in parts(F.col("sims"), len(langs), False)])
    return scored.select(F.col(key).alias("id"), F.concat(first, F.transform("sims", lambda v: F.round(v, 9))).alias("x"), *keep)


def fit_logistic(x: np.ndarray, ys: list[np.ndarray], total: Callable[[list[int]], list[int]] = list) -> list[np.ndarray]:
    """One model for each of `ys`. No intercept, weights from 1, one weight at a
    time by the summed gradient with a fixed rate; 10 to 20 rounds, ended by a
    small sum of gradients. Gradients are added up in whole units of 1 / UNIT, so
    that no order of the rows changes a sum (with this rate rounding would grow to
    other weights). `total` adds the models' sums up where `x` is a share of the rows."""
    ws = [np.ones(x.shape[1]) for _ in ys]
    zs = [x @ w for w in ws]
    moved = [0.0] * len(ys)
    x = np.asfortranarray(x)
    for turn in range(MOST_ROUNDS):
        going = [turn < LEAST_ROUNDS or m > SMALL_SUM for m in moved]
        if not any(going):
            break
        moved = [0.0 if g else m for g, m in zip(going, moved, strict=True)]
        for j in range(x.shape[1]):
            own = [0] * len(ys)
            for i in (i for i, goes in enumerate(going) if goes):
                error = ys[i] - 1.0 / (1.0 + np.exp(-np.clip(zs[i], -700, 700)))
                error[np.abs(error) <= SMALL_ERROR] = 0.0
                own[i] = int(np.rint(error * x[:, j] * UNIT).astype(np.int64).sum())
            for i, units in enumerate(total(own)):
                if going[i]:
                    g = units / UNIT
                    moved[i] += abs(g)
                    ws[i][j] += RATE * g
                    zs[i] += RATE * g * x[:, j]
    return ws


def exchange(context: BarrierTaskContext) -> Callable[[list[int]], list[int]]:
    """A function that adds lists of numbers up over the tasks of a barrier stage.
    The first task tells the others where it listens; `allGather` itself would
    take a second for each sum."""
    first, others = context.partitionId() == 0, len(context.getTaskInfos()) - 1
    if first:
        server, word = socket.create_server(("", 0)), uuid.uuid4().hex
        host = context.getTaskInfos()[0].address.split(":")[0]
        context.allGather(json.dumps([host, server.getsockname()[1], word]))
        peers = []
        while len(peers) < others:
            peer = server.accept()[0]
            peer.settimeout(PATIENCE_S)
            peer = peer.makefile("rwb")
            if peer.readline().decode().strip() == word:
                peers.append(peer)
    else:
        host, port, word = json.loads(context.allGather("")[0])
        one = socket.create_connection((host, port), PATIENCE_S)
        one.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        peers = [one.makefile("rwb")]
        peers[0].write(f"{word}\n".encode())
        peers[0].flush()

    def say(numbers: list[int]) -> None:
        for peer in peers:
            peer.write(json.dumps(numbers).encode() + b"\n")
            peer.flush()

    def total(own: list[int]) -> list[int]:
        if first:
            own = [sum(g) for g in zip(own, *(json.loads(peer.readline()) for peer in peers), strict=True)]
            say(own)
            return own
        say(own)
        return json.loads(peers[0].readline())

    return total


def train_logistic(rows: DataFrame, langs: list[str], tasks: int | None = None) -> DataFrame:
    """(lang, weights) from (id, x, truth): one model for each language, fitted on
    all rows. Each task holds its share of the rows; for each weight the tasks
    add their sums up, all languages at once, in a barrier stage. So memory goes
    with a task's share; there are no more tasks than cores."""
    if tasks is None:
        tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1), np.array(b.column(1).to_pylist(), object)) for b in batches if b.num_rows]
        size = 7 * len(langs)
        x, truth = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros((0, size)), np.zeros(0, object))
        context = BarrierTaskContext.get() if tasks > 1 else None
        total = exchange(context) if context else list
        ws = fit_logistic(x, [(truth == lang).astype(float) for lang in langs], total)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w.tolist() for w in ws], pa.list_(pa.float64()))], names=["lang", "weights"])

    return rows.repartition(tasks, "id").select("x", "truth").mapInArrow(run, "lang string, weights array<double>", barrier=tasks > 1)


def predict_logistic(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, lang, confidence) of (id, x); a model of another length is refused."""
    pairs = rows.crossJoin(F.broadcast(weights))  # one row for each language
    z = F.when(F.size("weights") == F.size("x"), dot(F.col("weights"), F.col("x"))).otherwise(F.raise_error(F.lit("the model has another number of weights")).cast("double"))
    return pairs.select("id", "lang", sigmoid(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))).alias("confidence"))


def report(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(lang, rows, mistakes, false_positives, false_negatives, and their shares)
    of (id, lang, confidence): positive is a confidence above the threshold."""
    said = F.coalesce(F.col("confidence") > threshold, F.lit(False))
    own = predictions.join(truth.select("id", F.col("lang").alias("truth")), "id")
    real = F.coalesce(F.col("lang") == F.col("truth"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    out = own.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), n(said != real).alias("mistakes"), n(said & ~real).alias("false_positives"), n(~said & real).alias("false_negatives"))
    return out.select("*", *[F.round(F.col(c) / F.col("rows"), 6).alias(f"{c}_share") for c in ("mistakes", "false_positives", "false_negatives")])


def write_weights(weights: DataFrame, path: str) -> None:
    """(lang, weights) as rows of a feature's number and weight."""
    weights.select("lang", F.posexplode("weights").alias("feature", "weight")).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str, features: int) -> DataFrame:
    """(lang, weights) of what `write_weights` wrote; empty where nothing lies at
    `path`. Refuses models that have not `features` weights."""
    if not exists(spark, path):
        return spark.createDataFrame([], "lang string, weights array<double>")
    rows = spark.read.schema("lang string, feature int, weight double").parquet(path)
    out = rows.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "weight"))), lambda x: x["weight"]).alias("weights"))
    fits = F.when(F.size("weights") == features, F.col("weights")).otherwise(F.raise_error(F.lit(f"a model has not {features} weights")).cast("array<double>"))
    return out.select("lang", fits.alias("weights"))


TREE = "bag int, lang string, node string, feature int, confidence double, n long"


def write_trees(trees: DataFrame, path: str) -> None:
    trees.select("bag", "lang", "node", "feature", "confidence", "n").write.mode("overwrite").parquet(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(path) if exists(spark, path) else spark.createDataFrame([], TREE)


def most_confident(predictions: DataFrame) -> DataFrame:
    """(id, lang_pred, confidence): the surest language, the first on ties; none
    where all are 0."""
    best = Window.partitionBy("id").orderBy(F.desc(F.round("confidence", 9)), "lang")
    return predictions.withColumn("k", F.row_number().over(best)).where("k = 1").select("id", F.when(F.col("confidence") > 0, F.col("lang")).alias("lang_pred"), F.round("confidence", 6).alias("confidence"))
