"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base statistics come from the words and lines of each whole text. They are
turned into a vector of `DIMS` transformed rates, shrunk towards a typical text
so that short ones do not scatter. For each language and source the minimum
covariance determinant estimate is found by concentration steps: take the share
`SUPPORT` of rows with the smallest Mahalanobis distances, estimate mean and
covariance from them, and again, from two starts per group; the start with the
smaller determinant counts. A text is rejected if its distance, with the
covariance scaled for consistency, is above `CUT`.

Steps add up moments by group and by fine bins of the distance; running sums
over the bins give the moments of the closest rows, so a step is one pass with
map-side sums and no group meets in one task. Groups under `MIN_ROWS` rows are
pooled by language; a pool still under it is judged by the estimate of its whole
language, and one of a language under it by that of the whole corpus.

Defined cases: a null text has no words (and fails the base rule); null
languages and sources are groups of their own; repeated rows and ties get equal
verdicts; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import let, load, materialize, release_shuffles, remove

SPACE = "[\\x20\\x09-\\x0D]+"
DIMS = 4
SUPPORT = 0.75
MIN_ROWS = 50
STEPS = 5
#: (h/n) / P(chi2 with 6 degrees <= the 0.75 quantile with 4).
CONSISTENCY = 1.485
#: Squared distance beyond which a text is rejected: the 0.9995 quantile of chi2
#: with 4 degrees.
CUT = 20.0
#: Least standard deviation of each rate: what counts as no difference.
FLOOR = (0.10, 0.35, 0.25, 0.25)
BINS = 32


def repeated_words(w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in `w`."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(8)]))

    def runs(s: Column, key: str) -> Column:
        """Positions of the sorted (key, p) structs whose key a neighbour shares."""
        m = F.size(s)
        own = lambda j: F.get(s, j)[key]
        same = F.filter(F.sequence(F.lit(0), m - 1), lambda j: ((j > 0) & (own(F.greatest(j - 1, F.lit(0))) == own(j))) | ((j + 1 < m) & (own(F.least(j + 1, m - 1)) == own(j))))
        return F.transform(same, lambda j: F.get(s, j)["p"])

    def exact(h: Column) -> Column:
        near = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("p")))), lambda s: runs(s, "x"))
        by_text = lambda c: F.sort_array(F.transform(c, lambda p: F.struct(F.array_join(F.slice(w, p + 1, 8), " ").alias("x"), p.alias("p"))))
        at = let(by_text(near), lambda s: F.when(F.size(s) > 0, F.sort_array(runs(s, "x"))).otherwise(F.array().cast("array<int>")))
        step = lambda q: F.aggregate(
            F.sequence(F.lit(0), F.size(q) - 1), F.lit(0).cast("long"), lambda a, j: a + F.when(j + 1 < F.size(q), F.least(F.lit(8), F.get(q, j + 1) - F.get(q, j))).otherwise(F.lit(8))
        )
        return let(at, lambda q: F.when(F.size(q) > 0, step(q)).otherwise(F.lit(0).cast("long")))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)))
    return F.when(n >= 8, some).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    of_words = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    each = docs.select("doc_id", "lang", "source", of_words.alias("w"), (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), of_lines.alias("l"))
    return each.select("doc_id", "lang", "source", "w.*", "n_symbols", "l.*")


def vector() -> list[Column]:
    """The transformed rates: word length, symbols, repeated lines, repeated words."""
    n = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 250.0) / (n + 50.0)),
        F.asinh(20.0 * F.col("n_symbols") / (n + 50.0)),
        F.asinh(10.0 * F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        F.asinh(5.0 * F.col("n_repeat_words") / (n + 50.0)),
    ]


def cholesky(rows: DataFrame) -> DataFrame:
    """Add the inverse Cholesky factor's parts l_ij and the log determinant of
    the covariance c_ij (lower triangle, floored variances)."""
    for i in range(DIMS):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return rows.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0)) * 2)


def distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i in range(DIMS):
        r = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))
        z.append(r / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def concentrated(rows: DataFrame, d2: Column) -> DataFrame:
    """Mean, covariance and Cholesky factor of each (group, start)'s closest
    SUPPORT rows by `d2`, to the resolution of the bins."""
    moments = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    bins = rows.withColumn("bin", F.floor(F.log2(d2 + 1e-9) * BINS)).groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *moments)
    upto = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", *(f"s{i}" for i in range(DIMS)), *(f"q{i}{j}" for i in range(DIMS) for j in range(i + 1))]
    summed = bins.select("group", "start", "bin", *[F.sum(c).over(upto).alias(c) for c in names], F.sum("n").over(Window.partitionBy("group", "start")).alias("total"))
    first = F.row_number().over(Window.partitionBy("group", "start").orderBy("bin"))
    chosen = summed.where(F.col("n") >= SUPPORT * F.col("total")).withColumn("k", first).where("k = 1")
    out = chosen.select("group", "start", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)], *[(F.col(f"q{i}{j}") / F.col("n")).alias(f"e{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    cov = lambda i, j: F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOOR[i] ** 2 if i == j else 0.0)
    out = out.select("*", *[cov(i, j).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    keep = ["group", "start", "log_det", *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i in range(DIMS) for j in range(i + 1))]
    return cholesky(out).select(*keep)


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group of (group, x0..)."""
    spark = rows.sparkSession
    mid = [F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIMS)]
    far = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(f"r{i}") for i in range(DIMS)]
    centre, centre_at = materialize(rows.groupBy("group").agg(*mid, *far), "centres")
    scaled = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest((F.col(f"r{i}")[1] - F.col(f"r{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(DIMS)]
    starts = rows.join(centre, "group").select("group", *[f"x{i}" for i in range(DIMS)], F.posexplode(F.array(sum((z * z for z in scaled), F.lit(0.0)), F.greatest(*[F.abs(z) for z in scaled]))).alias("start", "d"))
    found, found_at = materialize(concentrated(starts, F.col("d")), "estimate")
    remove(spark, centre_at)
    for _ in range(STEPS):
        new, new_at = materialize(concentrated(rows.join(found, "group"), distance()), "estimate")
        remove(spark, found_at)
        found, found_at = new, new_at
    best = Window.partitionBy("group").orderBy("log_det", "start")
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "start", "log_det")


def verdicts(docs: DataFrame) -> DataFrame:
    """Base statistics, base_failed, distance and kept of each row of `docs`."""
    spark = docs.sparkSession
    stats = statistics(docs).select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    stats, stats_at = materialize(stats, "statistics")
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("?"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("?"))
    sizes = stats.groupBy(lang.alias("lang_key"), source.alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    by_lang, small = Window.partitionBy("lang_key"), F.col("n") < MIN_ROWS
    pooled = F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_lang)
    whole_lang = F.concat(F.lit("*"), F.col("lang_key"))
    group = F.when(~small, F.concat_ws("\t", "lang_key", "source_key")).when(pooled >= MIN_ROWS, F.col("lang_key")).when(F.sum("n").over(by_lang) >= MIN_ROWS, whole_lang).otherwise(F.lit("*"))
    own = sizes.select("lang_key", "source_key", group.alias("group"))
    groups, groups_at = materialize(own.select("*", F.max(F.col("group") == whole_lang).over(by_lang).alias("lang_asked")), "groups")
    corpus_asked = not groups.where("group = '*'").isEmpty()
    rows = stats.withColumn("lang_key", lang).withColumn("source_key", source).join(groups, ["lang_key", "source_key"])
    # the groups whose estimate a row enters: its own, and the wider ones that small pools ask for
    enters = F.array_distinct(F.array_compact(F.array(F.col("group"), F.when(F.col("lang_asked"), whole_lang), F.lit("*" if corpus_asked else None).cast("string"))))
    found = estimates(rows.select(F.explode(enters).alias("group"), *[f"x{i}" for i in range(DIMS)]))
    found, found_at = materialize(found, "estimates")
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    d2 = distance() / CONSISTENCY
    out = rows.join(found, "group", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (d2 <= CUT)).alias("kept"), d2.alias("distance2"))
    release_shuffles(spark)
    return out


def op2_minimum_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(load(spark, sf_dir, "documents"))
