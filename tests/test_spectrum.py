"""All lags of the autocorrelation against the sum over pairs."""

import math

import numpy as np
import pytest

from gustlab.operators.spectrum import Grid, acf_full


def direct(x):
    d = np.asarray(x, float) - np.mean(x)
    den = float(d @ d)
    return [float(d[:len(d) - h] @ d[h:]) / den if den else None for h in range(len(d))]


@pytest.mark.parametrize("cells", [1, 8, 64, 1 << 20])
def test_bundles_of_any_size(spark, cells):
    g = np.random.default_rng(1)
    series = {"a": g.normal(size=37), "b": np.cumsum(g.normal(size=64)), None: g.normal(size=2), "one": [3.0], "flat": [2.0] * 9}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [("a", 99, None), ("b", 98, float("nan"))]
    g.shuffle(rows)
    df = spark.createDataFrame([(None if r[0] is None else str(r[0]), int(r[1]), None if r[2] is None else float(r[2])) for r in rows],
                               "s string, ts long, x double")
    got = {(r["s"], r["lag"]): r for r in acf_full(df, "x", by=["s"], cells=cells).collect()}
    assert len(got) == sum(len(x) for x in series.values())
    for k, x in series.items():
        for h, want in enumerate(direct(x)):
            r = got[(k, h)]
            assert r["n"] == len(x)
            if want is None:
                assert r["acf"] is None
            else:
                assert math.isclose(r["acf"], want, rel_tol=0, abs_tol=1e-12) and r["significant"] == (abs(want) > r["ci"])


def test_long_series_one_job_a_step(spark):
    g = np.random.default_rng(2)
    x = np.cumsum(g.normal(size=20_000))
    df = spark.range(20_000).withColumnRenamed("id", "ts").join(
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ts long, x double"), "ts")
    got = acf_full(df, "x", cells=1 << 12).orderBy("lag").collect()
    assert np.allclose([r["acf"] for r in got], direct(x), atol=1e-10)


def test_grid():
    for n in (1, 2, 3, 1000, 1 << 20, (1 << 20) + 1):
        g = Grid(n)
        assert 2 * n <= g.rows * g.cols < 4 * n + 1 and g.rows <= g.cols <= 2 * g.rows


def test_empty(spark):
    assert acf_full(spark.createDataFrame([], "ts long, x double"), "x").collect() == []
