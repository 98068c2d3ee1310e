"""What op1 spends: equal contexts are normalised once, steps add up as loops do, and no row is sorted."""

import numpy as np
import pytest

from glossa.llm import lm, nce


def trained(n: int = 300) -> tuple[nce.Shape, nce.Learner]:
    shape = nce.Shape(np.arange(1, n + 1))
    own = nce.Learner(shape, shape.start(), 0.1, 1)
    own.learn(iter([nce.contexts(np.random.default_rng(0).integers(1, n, 3000), np.array([3000]))]))
    return shape, own


def test_equal_contexts_are_normalised_over_the_classes_once(monkeypatch):
    shape, own = trained()
    scorer = nce.Scorer(shape, own.m)
    w = np.flatnonzero(shape.cls == np.bincount(shape.cls).argmin())[0]
    rows = np.repeat(np.array([[3, 5, w]], np.int32), 3000, 0)
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    got = scorer.log_probabilities(rows)
    assert got == pytest.approx(np.full(3000, got[0]), abs=1e-5)
    assert sum(taken) < 3000 * (shape.k + len(shape.members[shape.cls[w]]))


@pytest.mark.parametrize("shift", [0, 300, -300])
def test_scores_out_of_the_exponential_s_range(shift):
    shape, own = trained()
    m = own.m
    m[: shape.n + shape.k, 2 * nce.DIM] += shift
    rows = np.array([[3, 5, w] for w in range(shape.n)], np.int32)
    assert (10 ** nce.Scorer(shape, m).log_probabilities(rows)).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("n", [nce.BATCH, 37])
def test_a_step_is_the_sum_over_its_tokens(n):
    shape, own = trained()
    rng = np.random.default_rng(3)
    before, w = rng.integers(0, 60, 2 * n), rng.integers(0, 60, n)
    noise, k = np.concatenate([rng.integers(0, shape.n, nce.NOISE), rng.integers(0, shape.k, nce.CLASS_NOISE) + shape.n]), 2 * nce.DIM
    ids = np.concatenate([w, shape.cls[w] + shape.n, noise])
    r, q, sums = own.parts[0].astype(float), own.parts[1].astype(float), [x.astype(float) for x in own.sums]
    log_noise = np.log(np.concatenate([shape.p * nce.NOISE, shape.class_p * nce.CLASS_NOISE]))
    c, gr, gq = r[-k:], np.zeros_like(r), np.zeros_like(q)
    for i in range(n):
        a, b = before[2 * i], before[2 * i + 1]
        h = np.append(r[a] @ c[: nce.DIM] + r[b] @ c[nce.DIM :], 1)
        gh = np.zeros(nce.DIM + 1)
        for at, label in [(ids[i], 1), (ids[n + i], 1), *((x, 0) for x in noise)]:
            g = 1 / (1 + np.exp(log_noise[at] - h @ q[at])) - label
            gq[at] += g * h
            gh += g * q[at]
        gh = gh[: nce.DIM]
        gr[a] += c[: nce.DIM] @ gh
        gr[b] += c[nce.DIM :] @ gh
        gr[-k:] += np.concatenate([np.outer(r[a], gh), np.outer(r[b], gh)])
    own.step(before, ids, *nce.groups([before]), *nce.groups([ids]))
    for side, (x, g) in enumerate(((r, gr), (q, gq))):
        acc = sums[side] + (g**2).mean(1)
        assert own.sums[side] == pytest.approx(acc, rel=1e-3, abs=1e-4)
        assert np.abs(own.parts[side] - (x - own.rate * g / np.sqrt(acc + 1e-8)[:, None])).max() < 1e-3


def test_groups_of_several_steps():
    of_steps = [np.array([4, 1, 4, 4]), np.array([1, 1]), np.array([7])]
    rows = [np.arange(2 * len(x), dtype=np.float32).reshape(-1, 2) for x in of_steps]
    got = [(g.ids.tolist(), g.n.tolist(), g.sums(x).tolist()) for g, x in zip(nce.groups(of_steps), rows, strict=True)]
    assert got == [([1, 4], [1, 3], [[2, 3], [10, 13]]), ([1], [2], [[2, 4]]), ([7], [1], [[0, 1]])]


def test_op1_sorts_no_rows(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 4)) for i in range(20)] + [(None, None)], "doc_id long, text string")
    out = lm.score_documents(docs, docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    got = out.collect()
    assert len(got) == 21 and sum(r.doc_id is None for r in got) == 1
    assert all(r.n_known == r.n_tokens for r in got)
