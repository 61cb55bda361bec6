"""Echo-state forecasts against one loop in memory, and against windows on a series with a long memory."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import forecast as FC
from gustlab.operators import reservoir as R
from gustlab.operators.models import ridge_solve

START = dt.datetime(2024, 1, 1)


def series(n=700, delay=6, seed=0):
    """The level moves by what the input was ``delay`` rows ago."""
    g = np.random.default_rng(seed)
    u, x = g.normal(size=n), np.zeros(n)
    for t in range(1, n):
        x[t] = x[t - 1] + (u[t - delay] if t >= delay else 0.0) + 0.05 * g.normal()
    return u, x


def frame(spark, u, x, s="a"):
    rows = [(s, START + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(u, x))]
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, u double, x double").repartition(3)


def loop(u, x, cut, h, washout, **kw):
    net = R.Reservoir(1, **kw)
    v = ((u - u[:cut].mean()) / u[:cut].std(ddof=1))[:, None]
    z = np.column_stack([np.ones(len(v)), v, net.states(v)])
    rows = np.arange(washout, cut - h)
    coef = ridge_solve(z[rows].T @ z[rows], z[rows].T @ (x[rows] - x[rows + h]), 1e-4)
    test = np.arange(cut, len(x) - h)
    return {START + dt.timedelta(hours=int(t)): (x[t + h], x[t] - z[t] @ coef) for t in test}


@pytest.mark.parametrize("size", [160, 250, 100_000])
def test_equals_one_loop(spark, size):
    u, x = series()
    cut, h = 600, 3
    got = R.reservoir_forecast(frame(spark, u, x), "x", ["u"], str(START + dt.timedelta(hours=cut)), horizon=h, units=30, radius=0.8,
                               washout=150, rows_a_range=size).collect()
    want = loop(u, x, cut, h, 150, units=30, radius=0.8)
    assert len(got) == len(want) == 97
    for r in got:
        a, p = want[r["made_at"]]
        assert r["actual"] == a and abs(r["predicted"] - p) < 1e-6 and r["ts"] - r["made_at"] == dt.timedelta(hours=h)


def test_long_memory_beats_windows(spark):
    u, x = series(n=1500, seed=2)
    cut = str(START + dt.timedelta(hours=1300))
    df = frame(spark, u, x).drop("s")
    rmse = lambda d: d.select(F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2))).first()[0]
    a = rmse(R.reservoir_forecast(df, "x", ["u"], cut, washout=200))
    b = rmse(FC.lagged_forecast(df, "x", ["u"], cut, horizon=1, steps=3, train_days=50, val_days=1, test_days=8, model="rf", num_trees=10))
    assert a < 0.6 * b, (a, b)


def test_series_gaps_and_empty(spark):
    u, x = series(seed=3)
    cut = str(START + dt.timedelta(hours=600))
    one, two = frame(spark, u, x, "a"), frame(spark, u[::-1].copy(), x[::-1].copy(), None)
    hole = one.withColumn("x", F.when(F.hour("ts") == 5, F.lit(None)).otherwise(F.col("x"))).withColumn(
        "u", F.when(F.hour("ts") == 7, F.lit(float("nan"))).otherwise(F.col("u")))
    got = R.reservoir_forecast(hole.unionAll(two), "x", ["u"], cut, by=["s"], units=20, washout=100)
    n = {r["s"]: r["n"] for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert n[None] == 99 and 85 < n["a"] < 99 and got.where("predicted is null or isnan(predicted)").count() == 0
    assert R.reservoir_forecast(one.limit(0), "x", ["u"], cut).collect() == []
    flat = R.reservoir_forecast(one, "x", ["u"], str(START), units=5, washout=10)  # no training rows
    assert flat.count() == 699


def test_labels_of_test_rows_are_not_learned(spark):
    u, x = series(seed=4)
    cut = START + dt.timedelta(hours=600)
    jump = x + np.where(np.arange(len(x)) >= 600, 1000.0, 0.0)
    a, b = ({r["made_at"]: r["predicted"] for r in R.reservoir_forecast(frame(spark, u, v), "x", ["u"], str(cut), horizon=30, units=20,
                                                                       washout=100).collect()} for v in (x, jump))
    assert a.keys() == b.keys() and all(abs(b[t] - a[t] - 1000.0) < 1e-6 for t in a)
