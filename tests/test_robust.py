"""Robust kernel regression: gross errors, objective, and the same fit from all rows in memory."""

import numpy as np
import pytest

from gustlab.operators import robust as R


def frame(spark, outliers=0.0, n=600, seed=1):
    g = np.random.default_rng(seed)
    x = g.uniform(-2, 2, size=(n, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] + 0.1 * g.normal(size=n)
    bad = g.random(n) < outliers
    y = np.where(bad, y + 50.0, y)
    rows = [(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(3)


GRID = np.array([(a, b) for a in np.linspace(-1.5, 1.5, 7) for b in np.linspace(-1.5, 1.5, 7)])


def values(fit):
    return np.column_stack([np.ones(len(GRID)), fit.feature_map.apply(GRID)]) @ fit.coef


def test_gross_errors_move_it_by_less_than_a_tenth(spark):
    kw = dict(features=["a", "b"], label="y", keys=["id"], sigma=0.5, landmarks=60)
    _, _, clean = frame(spark)
    _, _, dirty = frame(spark, 0.05)
    moves = {}
    for robust in (True, False):
        a, b = (values(R.fit_robust_kernel(d, robust=robust, **kw)) for d in (clean, dirty))
        moves[robust] = np.abs(a - b).mean()
    assert moves[True] < 0.1 * moves[False], moves
    fit = R.fit_robust_kernel(dirty, **kw)
    truth = np.sin(2 * GRID[:, 0]) + GRID[:, 1]
    assert np.sqrt(np.mean((values(fit) - truth) ** 2)) < 0.15
    drops = np.diff(fit.objective)
    assert len(drops) >= 1 and (drops <= 0).all()


def test_same_fit_in_memory(spark):
    x, y, df = frame(spark, 0.05, n=300)
    fit = R.fit_robust_kernel(df, ["a", "b"], "y", ["id"], sigma=0.5, landmarks=40, delta=0.3, c=2.0)
    z = np.column_stack([np.ones(len(x)), fit.feature_map.apply(x)])
    ridge = np.eye(z.shape[1]) / 2.0
    ridge[0, 0] = 0
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    for _ in range(500):
        w = np.minimum(1, 0.3 / np.abs(y - z @ beta))
        beta = np.linalg.solve((z * w[:, None]).T @ z + ridge, z.T @ (w * y))
    r = np.abs(y - z @ beta)
    best = 2.0 * np.where(r <= 0.3, r * r / 2, 0.3 * (r - 0.15)).sum() + (beta[1:] ** 2).sum() / 2
    assert abs(fit.objective[-1] - best) < 1e-4 * best
    assert np.allclose(values(fit), np.column_stack([np.ones(len(GRID)), fit.feature_map.apply(GRID)]) @ beta, atol=0.02)


def test_landmarks_and_predictions(spark):
    _, _, df = frame(spark, n=50)
    all_of_them = R.landmark_rows(df.unionAll(df), ["a", "b"], ["id"], 500, 1)
    assert len(all_of_them) == 50  # repeated rows count once
    assert np.allclose(R.landmark_rows(df.repartition(7), ["a", "b"], ["id"], 9, 1), all_of_them[:9])
    fit = R.fit_robust_kernel(df, ["a", "b"], "y", ["id"], landmarks=20)
    got = fit.predict(df.unionByName(spark.createDataFrame([(99, None, 1.0, 2.0)], df.schema)))
    assert got.count() == 51 and got.where("id = 99 and (prediction is null or isnan(prediction))").count() == 1
    with pytest.raises(ValueError):
        R.fit_robust_kernel(df.limit(0), ["a", "b"], "y", ["id"])


def test_errors_of_zero(spark):
    df = spark.createDataFrame([(i, float(i % 5), 3.0) for i in range(40)], "id long, a double, y double")
    fit = R.fit_robust_kernel(df, ["a"], "y", ["id"])
    assert abs(float(fit.coef[0]) - 3.0) < 1e-6
