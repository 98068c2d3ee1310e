"""The engine's queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.languages import languages
from glossa.operators import boundary, classify, datasets, detect, evaluate, models, scorer
from glossa.operators.detector import ALGORITHMS, LanguageDetector
from glossa.operators.scorer import scored
from glossa.session import materialize, scratch_path
from glossa.sources.tables import corpus, documents, items, model, profiles

Query = Callable[[SparkSession, str], DataFrame]


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("id").alias("doc_id"), T.tokenize(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


def item_word_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return models.ngram_dimension(models.word_table(items(spark, d), []))


def item_cross_word_ngrams(spark: SparkSession, d: str) -> DataFrame:
    w = items(spark, d).select("id", T.tokenize(F.col("text")).alias("w")).where(F.size("w") > 1)
    pair = w.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i")).withColumn("n", F.explode(F.array(*[F.lit(n) for n in range(3, 7)])))
    grams = T.cross_word_ngrams(F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1), F.col("n"))
    return pair.select(F.col("id").alias("item_id"), F.col("i").alias("pos"), "n", F.explode(grams).alias("ngram"))


def jaccard_docs(spark: SparkSession, d: str) -> DataFrame:
    """Of the word sets of each document and the next one."""
    w = documents(spark, d).select("id", F.array_distinct(T.tokenize(F.col("text"))).alias("w"))
    other = w.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    return w.join(other, "id").select(F.col("id").alias("doc_id"), F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


def length_status(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("id").alias("doc_id"), T.length_status(F.col("text")).alias("status"))


def doc_ngram_freq(spark: SparkSession, d: str) -> DataFrame:
    return scorer.text_frequencies(documents(spark, d)).select(F.col("id").alias("doc_id"), "n", "ngram", F.round("freq", 6).alias("freq"))


def lang_model(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d)


def lang_model_topk(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).groupBy("lang", "n").agg(F.count(F.lit(1)).alias("entries"), F.max("weight").alias("most"), F.min("weight").alias("least"))


def model_lines(spark: SparkSession, d: str) -> DataFrame:
    return models.to_lines(model(spark, d))


def model_files(spark: SparkSession, d: str) -> DataFrame:
    """The profiles after a way through their text files."""
    path = scratch_path(spark, "profiles")
    models.write(model(spark, d), path)
    return models.read(spark, path)


def doc_norm(spark: SparkSession, d: str) -> DataFrame:
    return scorer.norms(documents(spark, d)).select(F.col("id").alias("doc_id"), "n", F.round("norm", 6).alias("norm"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    own = profiles(spark, d)
    return scored(corpus(spark, d), own), sorted({p[0] for p in own})


def raw_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows, langs = _scored(spark, d)
    return detect.from_scorer(rows, "doc_id", langs).select(F.col("id").alias("doc_id"), "n", "lang", F.round("score", 6).alias("score"))


def raw_similarity_items(spark: SparkSession, d: str) -> DataFrame:
    """The all-DataFrame plan of the same sums."""
    return detect.similarity(items(spark, d), model(spark, d)).select(F.col("id").alias("item_id"), "n", "lang", F.round("score", 6).alias("score"))


def _ranked(spark: SparkSession, d: str, ignore_low: bool) -> DataFrame:
    rows, langs = _scored(spark, d)
    return detect.ranked_in_row(rows, "doc_id", langs, ignore_low).select(F.col("id").alias("doc_id"), "lang", F.round("score", 6).alias("score"), "rnk")


def linear_scores_all(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, False)


def linear_scores_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, True)


def linear_scores_items(spark: SparkSession, d: str) -> DataFrame:
    """Ranked by the all-DataFrame plan."""
    out = detect.ranked(detect.linear(detect.similarity(items(spark, d), model(spark, d)), ignore_low=True))
    return out.select(F.col("id").alias("item_id"), "lang", F.round("score", 6).alias("score"), "rnk")


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].select("doc_id", F.col("lang").alias("lang_true"), "lang_pred", F.round("score", 6).alias("score"))


def detect_algorithms(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language by each algorithm, fitted on the documents, which
    are scored once."""
    own, out = LanguageDetector(profiles(spark, d)), None
    rows = materialize(own.scored(corpus(spark, d).withColumnRenamed("doc_id", "id")), "scored")[0]
    own.fit_scored(rows)
    for algorithm in ALGORITHMS:
        part = own.detect_scored(rows.drop("lang"), algorithm).select(F.col("id").alias("doc_id"), F.lit(algorithm).alias("algorithm"), "lang_pred")
        out = part if out is None else out.unionByName(part)
    return out


def language_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language by its display name."""
    n = corpus(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(languages(spark)), "lang", "left").select("lang", "name", "n")


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows, langs = _scored(spark, d)
    return detect.breakdown(rows, "doc_id", langs).withColumnRenamed("id", "doc_id")


def accuracy_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, d)[0])


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_scored(spark, d)[0])


def sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    return datasets.samples(corpus(spark, d)).select("doc_id", "lang", F.col("chunk").cast("long").alias("chunk"), "text", "split")


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return datasets.samples(corpus(spark, d)).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


def training_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = datasets.samples(corpus(spark, d)).where("split = 'train'")
    return datasets.take(rows, ratio=0.01).select("doc_id", "lang", F.col("chunk").cast("long").alias("chunk"), "text")


def training_first(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 training samples: the limit is the operator."""
    rows = datasets.samples(corpus(spark, d)).where("split = 'train'")
    return datasets.take(rows, first=100).select("doc_id", "lang", F.col("chunk").cast("long").alias("chunk"), "text")


def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each language and split after a way through files."""
    path = scratch_path(spark, "samples")
    datasets.write(datasets.samples(corpus(spark, d)), path)
    return datasets.read(spark, path).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _bigrams(spark: SparkSession, d: str) -> DataFrame:
    return boundary.bigram_counts(datasets.samples(corpus(spark, d)).where("split = 'train'"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _bigrams(spark, d)


def bigram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The count of each bigram of the items, 0 where it is unknown."""
    found = boundary.bigrams_of(items(spark, d)).join(_bigrams(spark, d), "bigram", "left")
    return found.select(F.col("id").alias("item_id"), F.col("pos").cast("long").alias("pos"), "bigram", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def unseen_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return boundary.unknown(documents(spark, d), _bigrams(spark, d), sampled=True).withColumnRenamed("id", "doc_id")


def _tagged(mode: str, source: Callable[[SparkSession, str], DataFrame], name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = boundary.tag(source(spark, d), profiles(spark, d), _bigrams(spark, d), mode, sampled=True)
        return out.select(F.col("id").alias(name), "seg", "text", "lang")

    return query


def multi_test_lines(spark: SparkSession, d: str) -> DataFrame:
    return datasets.multilingual_lines(datasets.samples(corpus(spark, d)))


def multi_line_files(spark: SparkSession, d: str) -> DataFrame:
    """The multilingual set after a way through its text files."""
    path = scratch_path(spark, "lines")
    datasets.write_lines(multi_test_lines(spark, d), path)
    return datasets.read_lines(spark, path)


def _merged(lines: DataFrame) -> DataFrame:
    return boundary.merge_lines(lines.withColumn("set", F.lit(0)), "set", "line_no")


def merge_consecutive_lines(spark: SparkSession, d: str) -> DataFrame:
    return _merged(multi_test_lines(spark, d)).select("seg", "lang", "text")


def phrase_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the whole multilingual set as one text (at most 30,000 lines)."""
    lines, _ = materialize(multi_test_lines(spark, d), "lines")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    text = lines.agg(whole.alias("text")).select(F.lit(0).cast("long").alias("id"), "text")
    found = boundary.tag(text, profiles(spark, d), _bigrams(spark, d), "window_4", sampled=True)
    return evaluate.phrase_metrics(found, _merged(lines))


def phrase_metrics_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines detected one by one and joined, against the true phrases."""
    lines, _ = materialize(multi_test_lines(spark, d), "lines")
    own = scored(lines.drop("lang"), profiles(spark, d)).select("line_no", F.col("lang_pred").alias("lang"))
    found = _merged(lines.drop("lang").join(own, "line_no"))
    return evaluate.phrase_metrics(found, _merged(lines))


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Found and expected phrases after a way through the files of a run."""
    lines, _ = materialize(multi_test_lines(spark, d), "lines")
    own = scored(lines.drop("lang"), profiles(spark, d)).select("line_no", F.col("lang_pred").alias("lang"))
    path = scratch_path(spark, "run")
    evaluate.write_run(_merged(lines.drop("lang").join(own, "line_no")), _merged(lines), path)
    return evaluate.read_run(spark, path)


def _scored_once(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows, langs = _scored(spark, d)
    return materialize(rows, "scored")[0], langs


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = classify.feature_rows(*_named(_scored(spark, d)))
    return rows.select(F.col("id").alias("doc_id"), "lang", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(7)])


def _named(own: tuple[DataFrame, list[str]]) -> tuple[DataFrame, str, list[str]]:
    return own[0], "doc_id", own[1]


def _binned(spark: SparkSession, d: str) -> DataFrame:
    rows, langs = _scored(spark, d)
    return classify.binned(classify.feature_rows(rows.withColumnRenamed("lang", "truth"), "doc_id", langs, "truth"))


def feature_bins(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d).withColumnRenamed("id", "doc_id")


def _whole(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bag", F.lit(0)).withColumn("w", F.lit(1).cast("long"))


def info_gain_root(spark: SparkSession, d: str) -> DataFrame:
    rows = _whole(_binned(spark, d)).withColumn("node", F.lit("")).withColumn("used", F.array().cast("array<int>"))
    return classify.gains(rows).select("lang", "feature", F.round("gain", 6).alias("gain"))


def _written(rows: DataFrame) -> DataFrame:
    return materialize(rows, "rows")[0]


def id3_tree(spark: SparkSession, d: str) -> DataFrame:
    return classify.id3(_written(_whole(_binned(spark, d))))


def tree_files(spark: SparkSession, d: str) -> DataFrame:
    """The printed tree, after a way through its files."""
    path = scratch_path(spark, "trees")
    classify.write_trees(id3_tree(spark, d), path)
    return classify.print_tree(classify.read_trees(spark, path))


def tree_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(_binned(spark, d))
    out = classify.predict_trees(rows.select("id", "lang", *[f"b{i}" for i in range(7)]), _written(classify.id3(_whole(rows))))
    return out.select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 6).alias("confidence"))


def bagged_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(_binned(spark, d))
    trees = _written(classify.id3(classify.bags(rows)))
    out = classify.predict_trees(rows.select("id", "lang", *[f"b{i}" for i in range(7)]), trees)
    return classify.most_confident(out).withColumnRenamed("id", "doc_id")


def _logistic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, langs = _scored_once(spark, d)
    x = _written(classify.vectors(rows.withColumnRenamed("lang", "truth"), "doc_id", langs, "truth"))
    path = scratch_path(spark, "weights")
    classify.write_weights(classify.train_logistic(x, langs), path)
    return x, classify.read_weights(spark, path, 7 * len(langs))


def logistic_weights(spark: SparkSession, d: str) -> DataFrame:
    """Trained weights after a way through their files."""
    return _logistic(spark, d)[1].select("lang", F.posexplode("weights").alias("feature", "weight"))


def logistic_predict(spark: SparkSession, d: str) -> DataFrame:
    x, weights = _logistic(spark, d)
    return classify.predict_logistic(x, weights).select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 6).alias("confidence"))


def logistic_report(spark: SparkSession, d: str) -> DataFrame:
    """Mistakes of the trained models at the threshold."""
    x, weights = _logistic(spark, d)
    return classify.report(classify.predict_logistic(x, weights), x.select("id", F.col("truth").alias("lang")))


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions by weights that are given: (5 (j + l) mod 7 - 3) / 10 for
    feature j of language l."""
    rows, langs = _scored_once(spark, d)
    weights = spark.createDataFrame([(lang, [(5 * (j + i) % 7 - 3) / 10 for j in range(7 * len(langs))]) for i, lang in enumerate(langs)], "lang string, weights array<double>")
    return classify.predict_logistic(classify.vectors(rows, "doc_id", langs), weights), rows.select(F.col("doc_id").alias("id"), "lang")


def logistic_given(spark: SparkSession, d: str) -> DataFrame:
    return _given(spark, d)[0].select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 6).alias("confidence"))


def logistic_given_report(spark: SparkSession, d: str) -> DataFrame:
    return classify.report(*_given(spark, d))


def ovr_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The surest of the linear scores as one-vs-rest confidences."""
    rows, langs = _scored(spark, d)
    best = detect.ranked_in_row(rows, "doc_id", langs, False).where("rnk = 1")
    return best.select(F.col("id").alias("doc_id"), F.when(F.col("score") > 0, F.col("lang")).alias("lang_pred"), F.round("score", 6).alias("confidence"))


def queries() -> dict[str, Query]:
    own = (
        tokenize, item_word_ngrams, item_cross_word_ngrams, jaccard_docs, length_status, doc_ngram_freq, lang_model, lang_model_topk, model_lines, model_files,
        doc_norm, raw_similarity, raw_similarity_items, linear_scores_all, linear_scores_filtered, linear_scores_items, detect_language, detect_algorithms,
        language_names, score_breakdown, accuracy_by_lang, confusion, sample_chunks, train_test_split, training_sample, training_first, split_files,
        bigram_counts, bigram_lookup, unseen_bigrams, multi_test_lines, multi_line_files, merge_consecutive_lines, phrase_metrics, phrase_metrics_lines,
        run_files, feature_vector, feature_bins, info_gain_root, id3_tree, tree_files, tree_predict, bagged_predict, logistic_weights, logistic_predict,
        logistic_report, logistic_given, logistic_given_report, ovr_argmax,
    )
    out = {f.__name__: f for f in own}
    for mode in boundary.MODES:
        out |= {f"tag_{mode}": _tagged(mode, documents, "doc_id"), f"item_tag_{mode}": _tagged(mode, items, "item_id")}
    return out
