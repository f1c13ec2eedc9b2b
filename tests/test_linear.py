"""The joint one-vs-rest solver against plain numpy."""

import numpy as np

from stoplens.operators import linear

ROWS = "entries array<struct<place:int,w:double>>, index int, weight double"


def data(spark, seed=3, n=60, size=7, classes=3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, size)) < 0.4, rng.normal(size=(n, size)), 0.0)
    x[:2] = 0  # rows without any entry
    label, weight = rng.integers(0, classes, n), rng.integers(1, 4, n).astype(float)
    rows = [([(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])], int(label[i]), float(weight[i])) for i in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(5), np.column_stack([x, np.ones(n)]), label, weight


def plain(w, x, label, weight, c):
    sign = np.where(label[None, :] == np.arange(len(w))[:, None], 1.0, -1.0)
    short = np.maximum(1 - sign * (w @ x.T), 0)
    return 0.5 * (w * w).sum() + c * (weight * short ** 2).sum(), w + c * (-2 * weight * sign * short) @ x


def test_objective_and_slope(spark):
    rows, x, label, weight = data(spark)
    w = np.random.default_rng(1).normal(size=(3, 8))
    value, slope = linear.evaluate(rows, w, 0.7)
    want, want_slope = plain(w, x, label, weight, 0.7)
    assert np.isclose(value, want) and np.allclose(slope, want_slope)


def test_fit_reaches_the_minimum(spark):
    rows, x, label, weight = data(spark)
    found = linear.fit_svm(rows, 3, 7, 1.0, tolerance=1e-5)
    w = np.zeros((3, 8))
    for _ in range(60_000):
        w -= 1e-3 * plain(w, x, label, weight, 1.0)[1]
    assert np.allclose(found, w, atol=1e-3)
    assert plain(found, x, label, weight, 1.0)[0] <= plain(w, x, label, weight, 1.0)[0] + 1e-4


def test_margins(spark):
    rows, x, *_ = data(spark)
    w = np.random.default_rng(2).normal(size=(3, 8))
    got = linear.score_svm(rows.selectExpr("entries", "to_json(entries) AS digest"), w).collect()
    want = {tuple(np.round(m, 9)) for m in (x @ w.T)}
    assert len(got) == 60 and {tuple(np.round(r["margins"], 9)) for r in got} == want
