"""Language detection as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import SIZES, top_k, trim_control
from glossa.operators.models import frequencies, word_table

LOW = 0.05


def text_frequencies(units: DataFrame) -> DataFrame:
    """(id, n, ngram, freq) of (id, text), words weighted by their length."""
    return frequencies(word_table(units, ["id"]), ["id"], adjust=True)


def norms(freq: DataFrame) -> DataFrame:
    """(id, n, norm) over each text's largest frequencies. Only their values
    matter, so the frequencies are sorted as numbers inside the group."""
    largest = F.slice(F.sort_array("f", asc=False), F.lit(1), top_k(F.col("n")))
    own = freq.groupBy("id", "n").agg(F.collect_list("freq").alias("f"))
    return own.select("id", "n", F.sqrt(F.aggregate(largest, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def similarity(units: DataFrame, model: DataFrame) -> DataFrame:
    """(id, n, lang, score), dense: 0 where nothing matches. All n-grams of the
    text count in the product, only the largest in the norm. The model is at
    most 907 rows a language, so it is broadcast."""
    freq = text_frequencies(units)
    langs = model.select("lang").distinct()
    dots = freq.join(F.broadcast(model.select("lang", "n", "ngram", "weight")), ["n", "ngram"]).groupBy("id", "n", "lang").agg(F.sum(F.col("freq") * F.col("weight")).alias("dot"))
    sizes = F.explode(F.array(*[F.lit(n) for n in SIZES])).alias("n")
    grid = units.select("id", F.length(trim_control(F.coalesce("text", F.lit("")))).alias("len"), sizes).crossJoin(F.broadcast(langs))
    full = grid.join(norms(freq), ["id", "n"], "left").join(dots, ["id", "n", "lang"], "left")
    value = F.when((F.col("len") >= F.col("n")) & (F.col("norm") > 0), F.coalesce("dot", F.lit(0.0)) / F.col("norm") * F.col("n")).otherwise(F.lit(0.0))
    return full.select("id", "n", "lang", value.alias("score"))


def cell(sims: Column, n: int, i: int, count: int) -> Column:
    """The score of size `n` and language `i` of `count` in a scorer's `sims`."""
    return F.get(sims, F.lit((n - 1) * count + i))


def from_scorer(scored: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """The rows of `similarity` from the row-local scorer's `sims`."""
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(lang).alias("lang"), cell(F.col("sims"), n, i, len(langs)).alias("score")) for n in SIZES for i, lang in enumerate(langs)])
    return scored.select(F.col(key).alias("id"), F.explode(cells).alias("c")).select("id", "c.n", "c.lang", "c.score")


def parts(sims: Column, count: int, ignore_low: bool) -> list[Column]:
    """Each language's linear combination in a scorer's `sims`; with
    `ignore_low` null where nothing counts."""
    most = [F.array_max(F.slice(sims, (n - 1) * count + 1, count)) for n in SIZES]
    out = []
    for i in range(count):
        own = [cell(sims, n, i, count) for n in SIZES]
        counts = [(s != 0) & (s >= LOW) if ignore_low else F.lit(True) for s in own]
        total = sum((F.when(c & (s > 0), s / (m * len(SIZES))).otherwise(F.lit(0.0)) for s, m, c in zip(own, most, counts, strict=True)), F.lit(0.0))
        out.append(F.when(reduce(lambda a, b: a | b, counts), total) if ignore_low else total)
    return out


def ranked_in_row(scored: DataFrame, key: str, langs: list[str], ignore_low: bool) -> DataFrame:
    """(id, lang, score, rnk) within each row of the scorer: six decimals
    descending, then language. Nothing is shuffled."""
    each = [F.struct((-F.round(p, 6)).alias("minus"), F.lit(lang).alias("lang"), p.alias("score")) for p, lang in zip(parts(F.col("sims"), len(langs), ignore_low), langs, strict=True)]
    order = F.array_sort(F.filter(F.array(*each), lambda x: x["score"].isNotNull()))
    rows = scored.select(F.col(key).alias("id"), F.posexplode(order).alias("k", "c"))
    return rows.select("id", "c.lang", "c.score", (F.col("k") + 1).alias("rnk"))


def linear(sim: DataFrame, ignore_low: bool) -> DataFrame:
    """(id, lang, score) of `similarity`: per size over the best language's
    score, averaged over the sizes. With `ignore_low` scores of 0 or under LOW
    do not count."""
    most = F.max("score").over(Window.partitionBy("id", "n"))
    rows = sim.withColumn("most", most)
    if ignore_low:
        rows = rows.where((F.col("score") != 0) & (F.col("score") >= LOW))
    part = F.when(F.col("score") > 0, F.col("score") / (F.col("most") * len(SIZES))).otherwise(F.lit(0.0))
    return rows.groupBy("id", "lang").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """Add rnk: score with six decimals descending, then language."""
    return scores.withColumn("rnk", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 6)), "lang")))


def breakdown(scored: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """One row for each text and language, a column for each size."""
    each = F.array(*[F.struct(F.lit(lang).alias("lang"), *[F.round(cell(F.col("sims"), n, i, len(langs)), 6).alias(f"gram_{n}") for n in SIZES]) for i, lang in enumerate(langs)])
    return scored.select(F.col(key).alias("id"), F.explode(each).alias("c")).select("id", "c.*")
