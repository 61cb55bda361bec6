"""Local-regression importances against a direct fit at each cut."""

import numpy as np
import pytest

from gustlab.operators import smooth as S


def direct(x, y, at, span):
    """Each cut by itself: the nearest share of the rows, tricube weights, a quadratic by least squares."""
    values, slopes = [], []
    for v in at:
        d = np.abs(x - v)
        h = np.sort(d)[int(np.ceil(span * len(x))) - 1]
        w = np.sqrt(np.maximum(0, 1 - (d / (h * (1 + 1e-9))) ** 3) ** 3)
        a = np.column_stack([np.ones(len(x)), x - v, (x - v) ** 2])
        b = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
        values.append(b[0])
        slopes.append(b[1])
    return np.array(values), np.array(slopes)


def data(n=500, seed=0):
    g = np.random.default_rng(seed)
    a, b, c = g.uniform(-3, 3, n), g.normal(size=n), g.normal(size=n)
    return a, b, c, np.sin(a) * 3 + 0.5 * b + 0.2 * g.normal(size=n)


@pytest.mark.parametrize("span", [0.75, 0.4])
def test_equals_the_direct_fit(spark, span):
    a, b, c, y = data()
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, y double").repartition(4)
    curves = S.local_curves(df, ["a", "b", "c"], "y", span)
    got = {r["feature"]: r for r in S.local_importance(df, ["a", "b", "c"], "y", span).collect()}
    for name, x in (("a", a), ("b", b), ("c", c)):
        at, value, slope = curves[name]
        assert at[0] == x.min() and at[-1] == x.max() and len(at) == S.cuts(span) + 1
        values, slopes = direct(x, y, at, span)
        assert np.allclose(value, values, atol=1e-8) and np.allclose(slope, slopes, atol=1e-7)
        fit = S.blend(x, at, values, slopes)
        want = max(0.0, 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert abs(got[name]["importance"] - want) < 1e-8 and got[name]["n"] == 500
    assert got["a"]["importance"] > 0.7 > got["b"]["importance"] > got["c"]["importance"] < 0.05


def test_blend_is_exact_for_cubics():
    at = np.array([-1.0, 0.0, 2.0])
    f, g = lambda x: x ** 3 - 2 * x, lambda x: 3 * x ** 2 - 2
    x = np.linspace(-1, 2, 50)
    assert np.allclose(S.blend(x, at, f(at), g(at)), f(x))
    assert S.blend(np.array([1.0, 5.0]), np.array([2.0]), np.array([7.0]), np.array([0.0])).tolist() == [7.0, 7.0]


def test_missing_constant_tied_and_empty(spark):
    a, _, _, y = data(200)
    rows = [(float(v), 1.0, float(i % 2), None, float(w)) for i, (v, w) in enumerate(zip(a, y))]
    rows += [(None, 1.0, 0.0, None, 1.0), (float("nan"), 1.0, 0.0, None, 2.0), (1.0, 1.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "a double, one double, tied double, none double, y double")
    got = {r["feature"]: r for r in S.local_importance(df, ["a", "one", "tied", "none"], "y").collect()}
    assert got["a"]["n"] == 200 and got["a"]["importance"] > 0.5
    assert got["one"]["n"] == 202 and abs(got["one"]["importance"]) < 0.05
    assert 0 <= got["tied"]["importance"] < 0.2
    assert got["none"]["importance"] is None and got["none"]["n"] == 0
    flat = df.selectExpr("a", "2.0D y")
    assert S.local_importance(flat, ["a"], "y").first()["importance"] is None
    assert S.local_importance(df.limit(0), ["a"], "y").first()["importance"] is None
