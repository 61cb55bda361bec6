"""Choice of d, residuals with MA terms, and the season regression path."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import forecast as FC
from gustlab.operators import timeseries as tsx
from gustlab.plans.workflows import season_regression


def frame(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ts int, x double")


def kpss_plain(x):
    x = np.asarray(x, float)
    n, d = len(x), x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    s2 = (d @ d) / n + 2 * sum((1 - h / (lags + 1)) * (d[:-h] @ d[h:]) / n for h in range(1, lags + 1))
    return (np.cumsum(d) ** 2).sum() / n ** 2 / s2, lags


@pytest.mark.parametrize("bucket", [10 ** 6, 37])
def test_kpss_matches_the_formula(spark, monkeypatch, bucket):
    orig = tsx._positions

    def small(df, order, by=(), idx=tsx.IDX, rows_per_bucket=None, *rest, **k):
        k.pop("rows_per_bucket", None)
        return orig(df, order, by, idx, bucket, *rest, **k)

    monkeypatch.setattr(tsx, "_positions", small)
    g = np.random.default_rng(0)
    noise, walk = g.standard_normal(300), np.cumsum(g.standard_normal(300))
    for x, d in ((noise, 0), (walk, 1)):
        r = FC.kpss(frame(spark, x), "x").first()
        want, lags = kpss_plain(x)
        assert r["lags"] == lags and r["n"] == 300 and r["kpss"] == pytest.approx(want)
        assert FC.choose_d(frame(spark, x), "x") == d
    assert FC.kpss(frame(spark, [2.0] * 10), "x").first()["kpss"] is None


def test_residuals_use_every_term(spark):
    g = np.random.default_rng(3)
    e = g.standard_normal(400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.5 * y[t - 1] + e[t] + 0.6 * e[t - 1]
    df = frame(spark, y)
    fit = FC.arima_fit(df, "x", max_p=7, d=0, max_q=2).cache()
    row = fit.first()
    res = {r["_pos"]: r["resid"] for r in FC.arima_residuals(df, "x", fit).collect()}
    m = max(8, len(row["coefs"]) + len(row["ma_coefs"]))
    X = np.column_stack([np.ones(400 - m)] + [y[m - j:400 - j] for j in range(1, m + 1)])
    beta = np.linalg.lstsq(X, y[m:], rcond=None)[0]
    inn = np.full(400, np.nan)
    inn[m:] = y[m:] - X @ beta
    p, q = len(row["coefs"]), len(row["ma_coefs"])
    for t in range(m + q, 400):
        want = y[t] - row["intercept"] - sum(row["coefs"][j - 1] * y[t - j] for j in range(1, p + 1)) \
            - sum(row["ma_coefs"][j - 1] * inn[t - j] for j in range(1, q + 1))
        assert res[t] == pytest.approx(want, abs=1e-6)
    assert len(res) == 400 - m - q if q else len(res) == 400 - p
    assert np.var(list(res.values())) < 1.3


def test_season_regression_parts_and_signal(spark):
    t0, g = dt.datetime(2020, 1, 1), np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b, c = map(float, g.standard_normal(3))
        rows.append((t0 + dt.timedelta(hours=i), f"M{i // 150}", float(50 + 10 * a + 3 * b + 0.1 * g.standard_normal()), c, a, b))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, filename string, p double, speed double, a double, b double")
    got = {(r["model"], r["part"]): r for r in season_regression(
        df, "p", "speed", ["p", "speed", "a", "b"], ["M0", "M1", "M2"], ["M3"],
        models={"rf": {"num_trees": 30}, "rbf": {}, "random_layer": {}}).collect()}
    assert set(got) == {(m, p) for m in ("rf", "rbf", "random_layer") for p in ("train", "test", "M3")}
    assert all(got[(m, "M3")]["n"] == 150 and got[(m, "train")]["n"] + got[(m, "test")]["n"] == 450 for m in ("rf", "rbf", "random_layer"))
    assert got[("random_layer", "M3")]["mean_error_pct"] < 5 and got[("rf", "M3")]["r2"] > 0.7


@pytest.mark.parametrize("bucket", [10 ** 6, 100])
def test_backtest_grid_cells(spark, monkeypatch, bucket):
    """A repeating daily pattern is forecast well at every horizon, from training rows alone; cells hold the test rows."""
    orig = tsx._positions

    def small(df, order, by=(), idx=tsx.IDX, rows_per_bucket=None, *rest, **k):
        k.pop("rows_per_bucket", None)
        return orig(df, order, by, idx, bucket, *rest, **k)

    monkeypatch.setattr(tsx, "_positions", small)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(hours=i), 100 + 30 * float(np.sin(i * np.pi / 12)), float(np.sin(i * np.pi / 12)), float(np.cos(i * np.pi / 12)))
            for i in range(24 * 20)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, p double, s double, c double")
    got = {(r["horizon"], r["origin"]): r for r in FC.backtest_grid(
        df, "p", ["s", "c"], [1, 5, 30], ["2024-01-12 00:00:00", "2024-01-16 00:00:00"]).collect()}
    assert len(got) == 6
    for (h, _), r in got.items():
        assert r["n"] == 25 and r["mean_error_pct"] < 3, (h, r)
