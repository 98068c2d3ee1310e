import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import boundary, scorer


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_tokenize(spark):
    s = "Il s'agit d'une Chaîne, “test” 42 $5!"
    want = ["il", "s", "agit", "d", "une", "chaîne", "test", "42", "$5"]
    assert one(spark, T.tokenize(F.lit(s))) == want == scorer.tokenize(s)


@pytest.mark.parametrize(("word", "n", "want"), [("banana", 2, {"$b", "ba", "an", "na", "a$"}), ("banana", 1, {"b", "a", "n"}), ("a", 3, {"$a$"}), ("a", 4, set()), ("x9y", 2, {"$x", "y$"})])
def test_ngrams(spark, word, n, want):
    got = one(spark, T.ngrams(F.lit(word), n))
    assert set(got) == want == set(scorer.ngrams(word, n)) and len(got) == len(want)


def test_cross_word(spark):
    assert set(one(spark, T.cross_word_ngrams(F.lit("ab"), F.lit("cd"), 3))) == {"b$c"}
    assert set(one(spark, T.cross_word_ngrams(F.lit("ab"), F.lit("cd"), 4))) == {"ab$c", "b$cd"}


def test_bins_entropy_length(spark):
    assert [one(spark, T.bin_of(F.lit(x))) for x in (0.3, 1.0, 0.0, -1.0)] == [3, 11, 1, 0]
    assert round(one(spark, T.entropy(F.lit(9.0), F.lit(14.0))), 6) == 0.940286
    assert [one(spark, T.length_status(F.lit("x" * n))) for n in (24, 25, 100_000, 100_001)] == ["too short", "ok", "ok", "too long"]


def test_linear_combination():
    own = scorer.Scorer([], ["en", "fr"])
    sims = [[0.8, 0.4], [0.04, 0.02], *[[0.0, 0.0]] * 4]
    assert own.combined(sims, True) == pytest.approx({"en": 1 / 6, "fr": 1 / 12})
    assert own.combined(sims, False) == pytest.approx({"en": 1 / 3, "fr": 1 / 6})
    assert scorer.Scorer([("en", 2, "ab", 1.0)]).detect("...") == (None, None)


def fixed(langs):
    return lambda a, b: langs[a]


def test_word_boundaries():
    assert boundary.by_word("a b c".split(), fixed(["en", None, "fr"])) == [("a b c", "fr")]
    assert boundary.by_word("a b".split(), fixed(["en", None])) == [("a b", None)]
    assert boundary.by_words("A B C D".split(), fixed(["en", "fr", "fr"]), 2) == [("A B", "en"), ("C", "fr")]
    assert boundary.by_words(["A"], fixed([]), 2) == [] and boundary.by_words(["A", "B"], fixed([]), 3) == []


def test_window_boundaries():
    tokens = "a b c d e f g".split()
    lang = lambda a, b: "en" if a == 0 and b <= 4 else "fr"
    assert boundary.by_window(tokens, [0] * 6, lang, 4) == [("a b c", "en"), ("d e f g", "fr")]
    assert len(boundary.by_window(tokens, [1] * 6, lang, 4)) == 1
    assert boundary.by_window(["a", "b"], [0], lambda a, b: None, 4) == [("a b", "en")]
    assert boundary.by_window([], [], lang, 4) == []
    for width in range(2, 7):
        assert " ".join(t for t, _ in boundary.by_window(tokens, [0] * 6, lang, width)) == " ".join(tokens)
    assert " ".join(t for t, _ in boundary.by_window(tokens, [0] * 6, lang, 5, nested=True)) == " ".join(tokens)
