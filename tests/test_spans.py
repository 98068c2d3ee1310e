"""Languages of many spans, known bigrams and samples against one at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import boundary, datasets, scorer, spans
from glossa.operators import lexicon as lex
from glossa.plans import registry
from glossa.sources.tables import corpus, profiles
from tests.conftest import SF

ODD = ["", "one", "\x01\x02a\x03 b \x01 c dd", "a b c d e f g h", " ".join("abcdefghijklmnop qrstuvwxyzäöüßéèáàíóúñç" * 9), "x-y, z. A|b | the of the of and la de der"]


@pytest.mark.parametrize("limit", [spans.MAX_TOKENS, 200])
def test_spans(spark, limit, monkeypatch):
    monkeypatch.setattr(spans, "MAX_TOKENS", limit)
    monkeypatch.setattr(spans, "FULL_TOKENS", 50)
    slow, own = scorer.Scorer(profiles(spark, SF)), spans.Spans(profiles(spark, SF))
    texts = [r.text for r in corpus(spark, SF).limit(30).collect()] + ODD
    draw = random.Random(2)
    called = lambda i: own.langs[i] if i >= 0 else None
    for a, b in lex.chunks(texts, 15_000):
        own.load(texts[a:b])
        ends = np.repeat(own.ends, np.diff(own.ends, prepend=0)).tolist()
        for width in (1, 2, 3, 6):
            found = own.windows(width)
            for p in draw.sample(range(len(ends)), min(60, len(ends))) + list(range(max(0, len(ends) - 30), len(ends))):
                want = slow.detect(" ".join(own.tokens[p : p + width]))[0] if p + width <= ends[p] else None
                assert called(found[p]) == want, own.tokens[p : p + width]
        cuts = sorted({0, *own.ends[:-1].tolist(), *draw.sample(range(len(ends)), len(ends) // 9)} - {len(ends)})
        for p, q, i in zip(cuts, [*cuts[1:], len(ends)], own.parts(np.array(cuts)), strict=True):
            assert called(i) == slow.detect(" ".join(own.tokens[p:q]))[0]


@pytest.mark.parametrize("mode", ["two_word", "window_2", "window_6", "nested"])
def test_tags_with_odd_rows(spark, mode):
    """Equal ids, texts without tokens, and bigrams that are no sample's."""
    texts = [r.text for r in corpus(spark, SF).limit(8).collect()] + ODD
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(-1, None)]
    known = {"The of", "x-y, z.", "a b", "the of", "of the"}
    bigrams = spark.createDataFrame([(x, 1) for x in known], "bigram string, cnt long")
    slow, want = scorer.Scorer(profiles(spark, SF)), []
    for i, t in rows:
        w = scorer.white_tokens(t or "")
        counts = [int(f"{a} {b}" in known) for a, b in zip(w, w[1:], strict=False)]
        want += [(i, k, *x) for k, x in enumerate(boundary.tags(w, counts, lambda s: slow.detect(s)[0], mode))]
    got = boundary.tag(spark.createDataFrame(rows, "id long, text string"), profiles(spark, SF), bigrams, mode).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_draws(spark):
    """The samples' draws are those of `draw`."""
    rows = datasets.samples(corpus(spark, SF).limit(20))
    train = F.pmod(T.draw("samples-split", F.col("doc_id"), F.col("chunk")), F.lit(10)) > 0
    length = 4 + F.pmod(T.draw("samples", F.col("doc_id"), F.col("chunk")), F.lit(4))
    wrong = rows.where((F.col("split") == "train") & (~train | (F.size(F.split("text", " ")) != length)))
    assert rows.where("split = 'train'").count() > 100 and wrong.count() == 0


@pytest.mark.parametrize("name", ["tag_window_3", "tag_base_bigram", "unseen_bigrams"])
def test_tokens_are_not_shuffled(spark, name):
    """A pack of texts and a block of bigrams are one row."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "pos#" not in plan.split("MapInArrow")[-1]
