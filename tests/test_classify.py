"""Classifiers see every row, whatever the number of tasks."""

import numpy as np

from glossa.operators import classify


def rows_of(n):
    draw = np.random.default_rng(5)
    x = draw.random((n, 14)).round(9)
    truth = [("en", "fr", None)[int(v > 0.5) + int(v > 0.95)] for v in x[:, 3]]
    return x, truth


def test_logistic_on_all_rows(spark):
    n = 3_000
    x, truth = rows_of(n)
    table = spark.createDataFrame([(i, x[i].tolist(), truth[i]) for i in range(n)], "id long, x array<double>, truth string").repartition(5)
    want = classify.fit_logistic(x, [np.array([t == lang for t in truth], float) for lang in ("en", "fr")])
    for tasks in (1, 3):
        got = {r.lang: r.weights for r in classify.train_logistic(table, ["en", "fr"], tasks).collect()}
        assert sorted(got) == ["en", "fr"]
        for lang, w in zip(("en", "fr"), want, strict=True):
            assert got[lang] == w.tolist(), tasks


def test_fit_is_one_weight_at_a_time(monkeypatch):
    """Against the loop for one model, row by row; at a rate at which rounding does not grow."""
    monkeypatch.setattr(classify, "RATE", 0.05)
    x, truth = rows_of(40)
    y = np.array([t == "en" for t in truth], float)
    w = np.ones(x.shape[1])
    for turn in range(classify.MOST_ROUNDS):
        if turn >= classify.LEAST_ROUNDS and moved <= classify.SMALL_SUM:  # noqa: F821
            break
        moved = 0.0
        for j in range(len(w)):
            errors = [y[i] - 1 / (1 + np.exp(-np.clip(x[i] @ w, -700, 700))) for i in range(len(y))]
            g = sum(e * x[i, j] for i, e in enumerate(errors) if abs(e) > classify.SMALL_ERROR)
            moved += abs(g)
            w[j] += classify.RATE * g
    (got,) = classify.fit_logistic(x, [y])
    assert np.allclose(got, w, rtol=1e-6)


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, x array<double>, truth string")
    assert classify.train_logistic(none, ["en"], 2).collect() == []
    same = spark.createDataFrame([(7, [0.5] * 7, "en")] * 3, "id long, x array<double>, truth string")  # a task has no rows
    one, two = (classify.train_logistic(same, ["en"], tasks).collect() for tasks in (1, 2))
    assert one == two and len(one) == 1


def test_trees_of_many_equal_rows(spark):
    """Rows that are written once or many times: equal rows are one to a tree."""
    rows = [(i, ("en", "fr")[i % 2], int(i % 3 == 0), *[(i * k) % 4 + 1 for k in range(1, 8)], 0, 1) for i in range(40)]
    schema = "id long, lang string, positive long, " + ", ".join(f"b{i} int" for i in range(7)) + ", bag int, w long"
    once = spark.createDataFrame(rows, schema)
    thrice = once.unionByName(once).unionByName(once)
    key = lambda df, m: sorted((r.bag, r.lang, r.node, str(r.feature), r.confidence, r.n * m) for r in df.collect())
    trees = classify.id3(once)
    assert key(trees, 3) == key(classify.id3(thrice), 1)
    found = classify.predict_trees(once.select("id", "lang", *classify.BINS), trees).collect()
    assert len(found) == 40 and {r.id for r in found} == set(range(40))
