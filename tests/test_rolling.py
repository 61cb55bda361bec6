"""Rolling-origin back-tests against cells fitted one by one, and against planted futures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import forecast as FC
from gustlab.operators import rolling as R
from gustlab.operators import timeseries as tsx
from gustlab.operators.models import RandomFeatureMap, ridge_solve

START = dt.datetime(2024, 1, 1)


def frame(spark, n=24 * 12, seed=0, series=None, drop=()):
    g = np.random.default_rng(seed)
    x, a, b = np.cumsum(g.normal(size=n)), g.normal(size=n), g.normal(size=n)
    rows = [(series, START + dt.timedelta(hours=i), float(x[i]), float(a[i]), float(b[i])) for i in range(n) if i not in drop]
    return rows, spark.createDataFrame(rows, "s string, ts timestamp_ntz, x double, a double, b double")


def cells(rows, horizons, window, steps, units, reg, min_rows):
    """Each cell by itself: its own rows, its own sums."""
    at = {r[1]: r for r in rows}
    first = min(at).date()
    days = sorted({t.date() for t in at})
    cut = dt.datetime.combine(first, dt.time()) + dt.timedelta(days=window)
    f = np.array([r[3:] for r in rows if r[1] < cut])
    mean, sd = f.mean(axis=0), f.std(axis=0, ddof=1)
    hour = dt.timedelta(hours=1)
    fm = RandomFeatureMap.relu([f"l{i}" for i in range(2 * steps)], units, 123)

    def z(t):
        lags = [at.get(t - j * hour) for j in range(steps)]
        return None if None in lags else np.concatenate([(np.array(v[3:]) - mean) / sd for v in lags])

    design = {t: v for t in at if (v := z(t)) is not None}
    design = dict(zip(design, np.column_stack([np.ones(len(design)), fm.apply(np.array(list(design.values())))])))
    out = {}
    for day in days:
        o = dt.datetime.combine(day, dt.time())
        for h in horizons:
            train = [t for t in design if t + h * hour in at and o - dt.timedelta(days=window) <= t + h * hour < o]
            test = sorted(t for t in design if t.date() == day and t + h * hour in at)
            if len(train) < min_rows or not test:
                continue
            zt = np.array([design[t] for t in train])
            y = np.array([at[t][2] - at[t + h * hour][2] for t in train])
            c = ridge_solve(zt.T @ zt, zt.T @ y, reg)
            for t in test:
                out[(day, h, t)] = (len(train), at[t + h * hour][2], at[t][2] - float(design[t] @ c), at[t][2])
    return out


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_equals_cells_fitted_alone(spark, chunk):
    rows, df = frame(spark, drop={30, 31, 100, 200})
    kw = dict(window=3, steps=2, units=6, reg=0.1, min_rows=10)
    got = R.rolling_predictions(df, "x", ["a", "b"], [1, 5, 25], chunk=chunk, **kw).collect()
    want = cells(rows, [1, 5, 25], **kw)
    assert len(got) == len(want) > 500
    for r in got:
        n, actual, predicted, level = want[(r["origin"], r["horizon"], r["made_at"])]
        assert (r["n_train"], r["actual"], r["persistence"]) == (n, actual, level)
        assert abs(r["predicted"] - predicted) < 1e-6


def test_series_by_key_and_gaps(spark):
    r1, d1 = frame(spark, seed=1, series="one")
    r2, d2 = frame(spark, seed=2, series=None, drop=set(range(50, 90)))
    kw = dict(window=3, steps=2, units=4, min_rows=10)
    both = R.rolling_predictions(d1.unionAll(d2), "x", ["a", "b"], [2], by=["s"], **kw)
    counts = {r["s"]: r["n"] for r in both.groupBy("s").agg(F.count("*").alias("n")).collect()}
    alone = [len(cells(r, [2], 3, 2, 4, 0.1, 10)) for r in (r1, r2)]
    assert counts == {"one": alone[0], None: alone[1]}


@pytest.mark.parametrize("h", [25, 48])
def test_labels_of_the_test_rows_are_not_learned(spark, h):
    """A jump that only labels from the origin on carry changes no coefficient, in both back-tests."""
    rows, df = frame(spark, seed=3)
    day = START + dt.timedelta(days=8)
    after = F.col("ts") >= F.lit(str(day)).cast("timestamp_ntz")
    jump = df.withColumn("x", F.when(after, F.col("x") + 1000).otherwise(F.col("x")))
    at = lambda d: {(r["made_at"]): r["predicted"] - r["persistence"] for r in R.rolling_predictions(
        d, "x", ["a", "b"], [h], window=5, steps=2, units=5).where(F.col("origin") == F.lit(day.date())).collect()}
    a, b = at(df), at(jump)
    assert a and a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-6 for t in a)
    # the grid: its test rows begin h hours before the given start
    late = F.col("ts") >= F.lit(str(day - dt.timedelta(hours=h))).cast("timestamp_ntz")
    flat = df.withColumn("x", F.when(late, 1000.0).otherwise(0.0))
    m = FC.backtest_grid(flat, "x", ["a", "b"], [h], [str(day)], units=5).first()
    assert abs(m["mae"]) < 1e-6  # nothing but zeros was learned; one learned label would move every forecast


def test_split_never_trains_on_test_rows(spark):
    rows, df = frame(spark)
    for h in (1, 25, 48):
        s = tsx.temporal_split(df, "2024-01-10 00:00:00", 7, 1, 1, h)
        first = dt.datetime(2024, 1, 10) - dt.timedelta(hours=h)
        assert s.where("split = 'train'").agg(F.max("ts")).first()[0] < first
        assert s.where("split = 'test'").agg(F.min("ts")).first()[0] == first


def test_metrics_and_empty(spark):
    _, df = frame(spark, n=24 * 6)
    got = R.rolling_backtest(df, "x", ["a"], [1, 2], window=2, units=4)
    assert {"origin", "horizon", "n_train", "mae", "mae_persistence"} <= set(got.columns) and got.count() > 4
    assert R.rolling_backtest(df.limit(0), "x", ["a"], [1]).collect() == []
