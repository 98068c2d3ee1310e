import math

import duckdb
import pytest

from glossa.operators import evaluate, models, scorer
from glossa.plans import registry
from glossa.sources.tables import corpus, profiles
from glossa.streaming import detect as streaming
from tests.conftest import SF

TABLES = ("documents", "benchmark")
CHECKED = [
    "tokenize", "item_cross_word_ngrams", "item_word_ngrams", "jaccard_docs", "doc_ngram_freq", "doc_norm", "lang_model", "model_files", "raw_similarity", "raw_similarity_items", "linear_scores_all",
    "linear_scores_filtered", "linear_scores_items", "score_breakdown", "detect_language", "language_names", "sample_chunks", "training_first", "split_files", "bigram_lookup", "unseen_bigrams",
    "multi_line_files", "run_files", "phrase_metrics_lines", "feature_vector", "feature_bins", "info_gain_root", "id3_tree", "tree_files", "tree_predict", "logistic_given", "logistic_given_report",
    "ovr_argmax", "item_tag_one_word", "item_tag_two_word", "item_tag_three_word", "item_tag_base_bigram", *(f"item_tag_window_{w}" for w in range(2, 7)),
]


def rows(names, values):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(clean(v[names.index(c)]) for c in sorted(names)) for v in values), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_model_files(spark, tmp_path):
    model = models.train(corpus(spark, SF))
    models.write(model, str(tmp_path / "m"))
    back = models.read(spark, str(tmp_path / "m"))
    key = lambda df: sorted((r.lang, r.n, r.ngram, r.weight) for r in df.select("lang", "n", "ngram", "weight").collect())
    assert key(model) == key(back)


def test_repeating_a_text_keeps_its_ranking(spark):
    own = scorer.Scorer(profiles(spark, SF))
    text = corpus(spark, SF).first()["text"] + " "
    a, b = (own.combined(own.similarities(t), True) for t in (text, text * 5))
    assert a == pytest.approx(b)


def test_phrase_metrics(spark):
    truth = spark.createDataFrame([(1, "en", "a b"), (2, "fr", "c"), (3, "de", "d")], "seg long, lang string, text string")
    found = spark.createDataFrame([("a b", "en"), ("c", "fr"), ("d", "de")], "text string, lang string")
    m = evaluate.phrase_metrics(found, truth).first()
    assert (m.n_true, m.correct, m.not_a_phrase, m.recall, m.precision, m.f1) == (2, 2, 1, 1.0, 0.666667, 0.8)


def test_stream(spark, tmp_path):
    docs = corpus(spark, SF)
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    own = profiles(spark, SF)
    stream = streaming.detect_stream(streaming.from_folder(spark, str(tmp_path / "in"), docs.schema.simpleString()[7:-1].replace(":", " ")), own)
    streaming.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


@pytest.mark.parametrize("mode", ["one_word", "base_bigram", "window_3", "nested"])
def test_tags_of_long_texts(spark, mode):
    from pyspark.sql import functions as F

    from glossa.operators import boundary, datasets

    own = scorer.Scorer(profiles(spark, SF))
    docs = corpus(spark, SF).where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "one")], "id long, text string"))
    bigrams = boundary.bigram_counts(datasets.samples(corpus(spark, SF)).where("split = 'train'"))
    known = {r.bigram: r.cnt for r in bigrams.collect()}
    want = []
    for i, t in ((r.id, r.text or "") for r in docs.collect()):
        w = scorer.white_tokens(t)
        counts = [known.get(f"{a} {b}", 0) for a, b in zip(w, w[1:])]
        want += [(i, k, *x) for k, x in enumerate(boundary.tags(w, counts, lambda s: own.detect(s)[0], mode))]
    got = [tuple(r) for r in boundary.tag(docs, profiles(spark, SF), bigrams, mode).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_algorithms(spark):
    from pyspark.sql import functions as F

    from glossa.operators.detector import LanguageDetector

    docs = corpus(spark, SF)
    own = LanguageDetector.learn(docs)
    units = docs.select(F.col("doc_id").alias("id"), "text")
    with pytest.raises(ValueError):
        own.detect(units, "trees")
    with pytest.raises(ValueError):
        own.detect(units, "other")
    own.fit(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for algorithm in ("linear", "trees", "logistic"):
        found = own.detect(units, algorithm).collect()
        assert len(found) == len(truth) and sum(r.lang_pred == truth[r.id] for r in found) > 0.9 * len(found), algorithm


def test_files(spark, tmp_path):
    from glossa.operators import classify, datasets

    weights = spark.createDataFrame([("en", [0.5, 1.0]), ("fr", [2.0, -1.0])], "lang string, weights array<double>")
    classify.write_weights(weights, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in classify.read_weights(spark, str(tmp_path / "w"), 2).collect()) == [("en", [0.5, 1.0]), ("fr", [2.0, -1.0])]
    with pytest.raises(Exception, match="3 weights"):
        classify.read_weights(spark, str(tmp_path / "w"), 3).collect()
    for missing in (classify.read_weights(spark, str(tmp_path / "no"), 2), classify.read_trees(spark, str(tmp_path / "no")), models.read(spark, str(tmp_path / "no")), datasets.read_lines(spark, str(tmp_path / "no"))):
        assert missing.count() == 0
    lines = spark.createDataFrame([(0, "a b", "en"), (1, "c", None), (2, "x : y", "fr")], "line_no long, text string, lang string")
    datasets.write_lines(lines, str(tmp_path / "l"))
    assert sorted(tuple(r) for r in datasets.read_lines(spark, str(tmp_path / "l")).collect()) == [("a b", "en"), ("c", None), ("x : y", "fr")]


def test_samples_of_long_texts(spark):
    from glossa.operators import datasets

    text = " ".join(f"w{'abcdefgh'[i % 8]}" for i in range(9000))
    docs = spark.createDataFrame([(1, "en", text), (2, "fr", None), (3, None, ""), (4, "en", "a b c d")], "doc_id long, lang string, text string")
    rows = datasets.samples(docs).orderBy("doc_id", "chunk").collect()
    at = 0
    words = text.split(" ")
    for r in (r for r in rows if r.doc_id == 1):
        n = len(r.text.split())
        assert r.text.split() == words[at : at + n] and (4 <= n <= 7 or at + n == 9000)
        at += n + 1
    assert at >= 9000 and [r.text for r in rows if r.doc_id == 4] == ["a b c d"] and {r.doc_id for r in rows} == {1, 3, 4}


def test_counts_by_window(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "en"), ("2024-01-01 00:02:00", "en"), ("2024-01-01 00:07:00", None)], "t string, lang_pred string").withColumn("t", F.to_timestamp("t"))
    got = sorted((str(r.window.start), str(r.lang_pred), r.n) for r in streaming.counts_by_window(rows, "t").collect())
    assert got == [("2024-01-01 00:00:00", "en", 2), ("2024-01-01 00:05:00", "None", 1)]
