"""Vectorised sums against the ones text by text."""

import random

import numpy as np
import pytest

from glossa.operators import lexicon as lex
from glossa.operators import scorer
from glossa.plans import registry
from glossa.sources.tables import corpus, profiles
from tests.conftest import SF

ODD = ["", "a", "ab", " \x01 ", "\x01\x02a\x03 b", "İstanbul ΣΑΣ straße ΣΣ. x9y a1b2 $5 “q”", "x" * 199 + " " + "y" * 200, "a" * 60 + " banana banana BANANA", "\ud800 b"]


def similarities(own, texts):
    parts = [own.similarities(b - a, *lex.words_of(own, texts[a:b]), lex.trimmed_lengths(texts[a:b])) for a, b in lex.chunks(texts)]
    return np.concatenate(parts)


@pytest.mark.parametrize("limit", [lex.MAX_WORDS, 300])
def test_similarities(spark, limit, monkeypatch):
    monkeypatch.setattr(lex, "MAX_WORDS", limit)
    monkeypatch.setattr(lex, "CHUNK_CHARS", 20_000)
    draw = random.Random(1)
    many = "".join(chr(draw.randint(33, 0xD7FF)) for _ in range(4000))
    texts = [r.text for r in corpus(spark, SF).limit(60).collect()] + ODD + [many] + ODD
    slow, own = scorer.Scorer(profiles(spark, SF)), lex.Lexicon(profiles(spark, SF))
    want = [slow.similarities(t) for t in texts]
    got = similarities(own, texts)
    assert np.abs(got - np.array(want)).max() < 1e-12
    total, counts = lex.combined(got)
    for at, sims in zip(lex.best(total, counts), want, strict=True):
        scores = slow.combined(sims, ignore_low=True)
        assert (own.langs[at] if at >= 0 else None) == (min(scores, key=lambda x: (-round(scores[x], 6), x)) if scores else None)


def test_no_profiles():
    own = lex.Lexicon()
    assert similarities(own, ["a"]).shape == (1, 6, 0)
    assert similarities(own, ["a b", ""]).shape == (2, 6, 0)
    assert list(lex.best(*lex.combined(np.zeros((2, 6, 0))))) == [-1, -1]


@pytest.mark.parametrize("name", ["doc_ngram_freq", "doc_norm", "detect_language", "feature_vector"])
def test_only_texts_are_shuffled(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "RoundRobin" in plan
