"""Model operators beat trivial baselines on planted signals (no SQL oracle exists for them)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import forecast as FC
from gustlab.operators import models as M


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    x1, x2 = rng.uniform(-2, 2, 3000), rng.uniform(-2, 2, 3000)
    y = 3 * np.sin(x1) + x2 ** 2 + rng.normal(0, 0.1, 3000)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, y double")


@pytest.mark.parametrize("fit", ["rf", "rbf", "random_layer"])
def test_models_beat_mean(spark, planted, fit):
    sp = M.stratified_split(planted, "y", keys=["id"]).cache()
    params = {"num_trees": 20} if fit == "rf" else {}
    fm = M.FITTERS[fit](sp.filter("split = 'train'"), ["x1", "x2"], "y", **params)
    m = ev.regression_metrics(fm.predict(sp.filter("split = 'test'")), "y", "prediction").first()
    sd = sp.filter("split = 'test'").agg(F.stddev_pop("y")).first()[0]
    assert m["rmse"] < 0.5 * sd


def test_linear_cv_matches_refit(spark, planted):
    fmap = M.RandomFeatureMap.relu(["x1", "x2"], 16)
    cv = M.linear_cv(planted, fmap, "y", ["id"], folds=3, repeats=1, reg=1e-3).collect()
    assert len(cv) == 3 and all(r["r2_corr"] > 0.8 for r in cv)


def test_arima_recovers_ar1(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for _ in range(3000):
        x.append(0.6 * x[-1] + rng.normal())
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    fit = FC.arima_fit(df, "v", max_p=3, d=0).first()
    assert fit["p"] >= 1 and fit["coefs"][0] == pytest.approx(0.6, abs=0.05)
    fc = FC.arima_forecast(df, "v", 3, max_p=3, d=0).orderBy("step").collect()
    assert len(fc) == 3 and abs(fc[0]["forecast"]) < 4


def test_permutation_importance_finds_signal(spark, planted):
    fm = M.fit_random_layer(planted, ["x1", "x2"], "y", units=64)
    noise = planted.withColumn("x3", F.rand(3))
    fm3 = M.fit_random_layer(noise, ["x1", "x2", "x3"], "y", units=64)
    imp = {r["feature"]: r["importance"] for r in M.permutation_importance(fm3, noise, "y", ["id"]).collect()}
    assert imp["x1"] > imp["x3"] and imp["x2"] > imp["x3"]
    assert fm is not None


def test_arima_ma_term_recovered(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=4001)
    x = [e[i] + 0.6 * e[i - 1] for i in range(1, 4001)]
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    fit = FC.arima_fit(df, "v", max_p=2, d=0, max_q=2).first()
    assert fit["q"] >= 1 and fit["ma_coefs"][0] == pytest.approx(0.6, abs=0.08)
    fc = FC.arima_forecast(df, "v", 3, max_p=2, d=0, max_q=2).orderBy("step").collect()
    assert len(fc) == 3 and abs(fc[2]["forecast"]) < 1.0


def test_t9_weather_workflow_refit_option(spark):
    from gustlab.operators import timeseries as tsx
    from gustlab.plans import standins as S
    from gustlab.plans.workflows import weather_to_final

    d = "/root/testdata/sf0.001"
    h = tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES).cache()
    w = S.weather_hourly(spark, d).drop("month_label").cache()
    a = weather_to_final(h, w, "active_power_kw")
    b = weather_to_final(h, w, "active_power_kw", refit=True)
    assert a.count() == b.count() > 0
    assert a.filter("pressure IS NULL").count() == 0 and b.filter("pressure IS NULL").count() == 0


def test_sensor_workflow_donor_years_and_constant_drop(spark):
    from gustlab.plans.workflows import sensor_to_hourly

    def at(y, m):
        return dt.datetime(y, 7, 1, 5, m)

    rows = [("Jul2017", "WT01", at(2017, 0), 10.0, 5.0, 1.0), ("Jul2017", "WT01", at(2017, 10), 12.0, 5.5, 1.0),
            ("Jul2017", "WT02", at(2017, 0), 30.0, 6.0, 1.0), ("Jul2017", "WT02", at(2017, 10), 32.0, 6.5, 1.0),
            ("Jul2018", "WT01", at(2018, 0), None, 7.0, 1.0), ("Jul2018", "WT01", at(2018, 10), 14.0, 7.5, 1.0),
            ("Jul2018", "WT02", at(2018, 0), 20.0, 8.0, 1.0), ("Jul2018", "WT02", at(2018, 10), 22.0, 8.5, 1.0)]
    df = spark.createDataFrame(rows, "filename string, turbine string, ts timestamp_ntz, p double, w double, c double")
    out, cols = sensor_to_hourly(df, ["p", "w", "c"], "p", "w", turbines=["WT01", "WT02"], select=False)
    got = {r["ts"]: (r["p"], r["w"]) for r in out.collect()}
    assert cols == ["p", "w"]  # c is constant in every month x turbine
    # 2018 WT01 05:00 took its 2017 row (10, 5): WT01 means (12, 6.25), WT02 (21, 8.25); max per column
    assert got[dt.datetime(2018, 7, 1, 5)] == (21.0, 8.25)
    assert got[dt.datetime(2017, 7, 1, 5)] == (31.0, 6.25)


def test_grid_cv_equals_one_penalty_at_a_time(spark, planted):
    fmap = M.RandomFeatureMap.rbf(["x1", "x2"], 20, 0.1)
    regs = [0.5, 0.005]
    both = {(r["reg"], r["repeat"], r["fold"]): r["rmse"] for r in M.ridge_grid_cv(planted, fmap, "y", ["id"], regs, 3, 2).collect()}
    for reg in regs:
        one = {(r["repeat"], r["fold"]): r["rmse"] for r in M.linear_cv(planted, fmap, "y", ["id"], 3, 2, reg=reg).collect()}
        assert one == pytest.approx({k[1:]: v for k, v in both.items() if k[0] == reg}) and len(one) == 6
    tuned = M.rbf_tuning(planted, fmap.inputs, "y", ["id"], sigmas=(0.01, 0.2), costs=(1.0, 100.0), folds=3, repeats=1, units=30).collect()
    assert len(tuned) == 4 and [r["best"] for r in tuned].count(True) == 1
    assert min(r["rmse"] for r in tuned) == next(r["rmse"] for r in tuned if r["best"])


def test_split_of_many_rows_equals_numbered_split(spark):
    """Above ``rows_per_bucket`` rows are compared with the last training row; copies of it are divided, NULL keys come first,
    and no window or sort runs over the rows."""
    rows = [(None if i % 50 == 0 else i % 97, i % 5, float(i % 40) if i % 31 else None, i) for i in range(2000)]
    rows += [(7, 3, 5.0, 5000 + i) for i in range(400)]  # equal in order key and tie-break
    df = spark.createDataFrame(rows, "k int, t int, y double, id int")
    lehmer = F.col("k") * 48271 % 1009
    cases = [(0.7, lehmer, ["t"], ["k", "t"]), (0.013, lehmer, ["t"], ["k", "t"]), (0.0, lehmer, ["t"], []), (1.0, lehmer, ["t"], []),
             (0.7, F.lit(1), ["t"], ["t"]), (0.7, F.xxhash64("id"), ["id"], ["id"])]
    for p, key, tiebreak, alike in cases:  # rows alike in these may change places
        args = dict(p=p, keys=["id"], shuffle_key=key, tiebreak=tiebreak)
        got = M.stratified_split(df, "y", rows_per_bucket=10, **args).cache()
        want = M.stratified_split(df, "y", **args)
        assert got.columns == want.columns
        count = lambda d: sorted(map(tuple, d.groupBy("stratum", "split", *alike).count().collect()), key=str)
        assert count(got) == count(want), (p, tiebreak)
        assert got.select("id").distinct().count() == got.count() == df.where("y IS NOT NULL").count()
    plan = M.stratified_split(df, "y", keys=["id"], rows_per_bucket=10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_map_cosine_is_exact(spark):
    z = np.random.default_rng(1).normal(0.0, 200.0, (500, 40))
    assert np.abs(M._cos(z) - np.cos(z)).max() < 5e-15
    odd = np.array([[1e9, np.nan, np.inf, 0.0]])
    with np.errstate(invalid="ignore"):
        assert np.array_equal(M._cos(odd), np.cos(odd), equal_nan=True)


def test_permutation_importance_scores_all_inputs_in_one_join(spark, planted, monkeypatch):
    """Equal to a join and a scoring an input; the rows are joined once, also for a tree model."""
    joins = []
    join = type(planted).join
    for fit in ("random_layer", "rf"):
        params = {"num_trees": 3} if fit == "rf" else {}
        fm = M.FITTERS[fit](planted, ["x1", "x2"], "y", **params)
        monkeypatch.setattr(type(planted), "join", lambda self, *a, **k: joins.append(1) or join(self, *a, **k))
        got = {r["feature"]: r["importance"] for r in M.permutation_importance(fm, planted, "y", ["id"]).collect()}
        monkeypatch.undo()
        assert len(joins) == 1
        joins.clear()
        rows = [r.asDict() for r in planted.withColumn("h", F.xxhash64("id", F.lit(7))).collect()]
        own, other = sorted(rows, key=lambda r: r["id"]), sorted(rows, key=lambda r: (r["h"], r["id"]))
        rmse = lambda d: ev.regression_metrics(fm.predict(d), "y", "prediction").first()["rmse"]
        for c in ("x1", "x2"):
            swapped = spark.createDataFrame([(a["id"], *[(b if f == c else a)[f] for f in ("x1", "x2")], a["y"]) for a, b in zip(own, other)],
                                            "id long, x1 double, x2 double, y double")
            assert got[c] == pytest.approx(rmse(swapped) - rmse(planted), abs=1e-9)
