"""Registered queries: modelling, scoring and forecasting.

Only the split has a SQL twin; model fits have none, so the driver records row checks for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import forecast as FC
from gustlab.operators import models as M
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S
from gustlab.plans.catalog import present, register, round_sql

X = S.WIDE_X
Y = "net_price"
KEYS = ["row_id"]
TIEBREAK = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Reproducible in both engines: a Lehmer step on the (bounded) key, then the seed.
SHUFFLE_SQL = "((((l_orderkey * 8 + l_linenumber) % 1000003) * 48271 + 123) % 2147483647)"


def _shuffle_key():
    k = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 1000003
    return (k * 48271 + 123) % 2147483647


def _split(spark, d):
    return M.stratified_split(S.wide_features(spark, d), Y, p=0.7, groups=5, keys=KEYS, shuffle_key=_shuffle_key(),
                              tiebreak=TIEBREAK)


def _scaled_split(spark, d):
    """The split with scaled inputs, cached: the model fit and the scoring read it. The scaler fit needs neither the row ids nor
    the split, so it reads the tables instead of a second cached copy."""
    return tsx.zscore(_split(spark, d), X, centre_constant=True).cache()


def _q(col, p):
    return f"""(SELECT olo.{col} + ((n - 1) * {p} - floor((n - 1) * {p})) * (ohi.{col} - olo.{col})
              FROM o olo, o ohi, (SELECT count(*) AS n FROM o)
              WHERE olo.i = floor((n - 1) * {p}) AND ohi.i = least(floor((n - 1) * {p}) + 1, n - 1))"""


@register("stratified_split", f"""
    WITH w AS ({S.WIDE_FEATURES_SQL}),
    o AS (SELECT {Y}, row_number() OVER (ORDER BY {Y}) - 1 AS i FROM w WHERE {Y} IS NOT NULL),
    b AS (SELECT w.*, CAST(1 + (CASE WHEN {Y} > {_q(Y, 0.25)} THEN 1 ELSE 0 END)
                            + (CASE WHEN {Y} > {_q(Y, 0.5)} THEN 1 ELSE 0 END)
                            + (CASE WHEN {Y} > {_q(Y, 0.75)} THEN 1 ELSE 0 END) AS INTEGER) AS stratum,
                 {SHUFFLE_SQL} AS sk
          FROM w WHERE {Y} IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sk, {", ".join(TIEBREAK)}) - 1 AS pos,
                 count(*) OVER (PARTITION BY stratum) AS n FROM b)
    SELECT l_orderkey, l_linenumber, l_shipdate, {", ".join(X)}, {Y}, stratum,
           CASE WHEN pos < ceil(n * 0.7) THEN 'train' ELSE 'test' END AS split
    FROM r
""")
def q_stratified_split(spark, d):
    """H1: 70/30 split sampled inside 4 quantile bins of the target (reproducible order, no rand())."""
    return _split(spark, d).drop("row_id")


def _fit_and_score(spark, d, model, **params):
    sp = _split(spark, d).cache()
    fm = M.FITTERS[model](sp.filter(F.col("split") == "train"), X, Y, **params)
    return sp, fm, fm.predict(sp)


@register("rf_regression_metrics")
def q_rf_regression_metrics(spark, d):
    """H5 + H12 + H13: random forest (mtry 4, 50 trees) on the train split, metrics on train and test."""
    _, _, scored = _fit_and_score(spark, d, "rf", num_trees=50, mtry=4)
    return ev.regression_metrics(scored, Y, "prediction", by=["split"])


@register("rbf_regression_metrics")
def q_rbf_regression_metrics(spark, d):
    """H6: RBF random-feature regression (sigma 0.2, C 10) on scaled inputs, metrics by split."""
    sp = _scaled_split(spark, d)
    fm = M.fit_rbf_regression(sp.filter(F.col("split") == "train"), X, Y, sigma=0.2, c=10.0)
    return ev.regression_metrics(fm.predict(sp), Y, "prediction", by=["split"])


@register("random_layer_metrics")
def q_random_layer_metrics(spark, d):
    """H7: 64-unit random ReLU layer + least-squares output on scaled inputs, metrics by split."""
    sp = _scaled_split(spark, d)
    fm = M.fit_random_layer(sp.filter(F.col("split") == "train"), X, Y, units=64)
    return ev.regression_metrics(fm.predict(sp), Y, "prediction", by=["split"])


@register("compare_models")
def q_compare_models(spark, d):
    """H15 + C6: test rows with the actual and each model's prediction side by side (joined on the key)."""
    sp = _scaled_split(spark, d)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    preds = {
        "rf": M.fit_random_forest(train, X, Y, num_trees=50, mtry=4).predict(test),
        "rbf": M.fit_rbf_regression(train, X, Y).predict(test),
        "random_layer": M.fit_random_layer(train, X, Y).predict(test),
    }
    return ev.compare_models(test.select(*KEYS, Y), KEYS, preds)


@register("feature_importance")
def q_feature_importance(spark, d):
    """Impurity importance of each input in the forest."""
    _, fm, _ = _fit_and_score(spark, d, "rf", num_trees=50, mtry=4)
    return spark.createDataFrame(fm.importances(), "feature string, importance double")


@register("permutation_importance")
def q_permutation_importance(spark, d):
    """H11 for models without built-in importances: RMSE increase when one input is permuted (random layer)."""
    sp = _scaled_split(spark, d)
    fm = M.fit_random_layer(sp.filter(F.col("split") == "train"), X, Y)
    return M.permutation_importance(fm, sp.filter(F.col("split") == "test"), Y, KEYS)


@register("cv_summary")
def q_cv_summary(spark, d):
    """H4 + H14: 10-fold x 3 repeated CV of the random-layer and RBF models (two passes each over the train
    rows); min/quartiles/mean/max of the fold metrics per model."""
    sp = _scaled_split(spark, d).filter(F.col("split") == "train")
    a = M.linear_cv(sp, M.RandomFeatureMap.relu(X, 64), Y, KEYS, folds=10, repeats=3, model="random_layer")
    b = M.linear_cv(sp, M.RandomFeatureMap.rbf(X, 200, 0.2), Y, KEYS, folds=10, repeats=3, reg=1 / (2 * 10.0),
                    model="rbf")
    return ev.cv_summary(a.unionByName(b), "model", ("mae", "rmse", "r2_corr"))


@register("rbf_tuning")
def q_rbf_tuning(spark, d):
    """H6 + H4: the kernel regression's 4 x 5 sigma x C grid by 10-fold x 3 repeated CV on the scaled training hours."""
    inputs = [c for c in S.SCADA_FEATURES if c != "active_power_kw"]
    sp = M.stratified_split(_hourly(spark, d), "active_power_kw", keys=["ts"])
    sp = tsx.zscore(sp.cache(), inputs, F.col("split") == "train", centre_constant=True)
    return M.rbf_tuning(sp.filter(F.col("split") == "train"), inputs, "active_power_kw", ["ts"])


@register("cv_folds_forest")
def q_cv_folds_forest(spark, d):
    """H4 for the forest: 10-fold CV, one refit per fold (20 trees), per-fold metrics."""
    sp = _split(spark, d).filter(F.col("split") == "train")
    return M.repeated_cv(sp, X, Y, KEYS, model="rf", folds=10, repeats=1, num_trees=20, mtry=4)


@register("rfe_selection")
def q_rfe_selection(spark, d):
    """Recursive feature elimination by forest importance, 5-fold CV RMSE at each subset size."""
    sp = _split(spark, d).filter(F.col("split") == "train")
    return M.rfe(sp, X, Y, KEYS, folds=5, sizes=[1, 3, 5, 7], num_trees=20, mtry=4)


# ------------------------------------------------------------------------------------------- H8, H16
def _hourly(spark, d):
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES)


FORECAST_X = ["wind_speed_ms", "temp_rotor_bearing_c", "hub_temp_c"]


@register("lagged_forecast")
def q_lagged_forecast(spark, d):
    """H8: 1-hour-ahead power from 3 hours of feature history (GBT, early stop on the validation day)."""
    scored = FC.lagged_forecast(_hourly(spark, d), "active_power_kw", FORECAST_X, "2024-01-20 00:00:00",
                                horizon=1, steps=3, train_days=7, val_days=1, test_days=1, model="gbt")
    return ev.regression_metrics(scored, "actual", "predicted")


@register("backtest")
def q_backtest(spark, d):
    """Horizons 1 and 24 hours from two origins, metrics per cell."""
    return FC.backtest(_hourly(spark, d), "active_power_kw", FORECAST_X, [1, 24],
                       ["2024-01-20 00:00:00", "2024-01-25 00:00:00"], model="gbt", steps=3)


@register("backtest_horizons")
def q_backtest_horizons(spark, d):
    """Every horizon from 1 to 48 hours from two origins, all cells from one prepared table."""
    return FC.backtest_grid(_hourly(spark, d), "active_power_kw", FORECAST_X, range(1, 49),
                            ["2024-01-20 00:00:00", "2024-01-25 00:00:00"])


# ------------------------------------------------------------------------------------------- H9
@register("arima_forecast")
def q_arima_forecast(spark, d):
    """H9: ARIMA(p,1,q), p <= 5, q <= 2 by AICc on daily revenue before 2001; 30-day forecast scored against the
    next 30 days."""
    s = S.farm_series(spark, d)
    train = s.filter(F.col("ts") < F.lit("2001-01-01").cast("timestamp_ntz"))
    test = tsx.sequence_index(s.filter(F.col("ts") >= F.lit("2001-01-01").cast("timestamp_ntz")), "ts")
    fc = FC.arima_forecast(train, "revenue", 30, max_p=5, d=1, max_q=2)
    j = fc.join(test.select((F.col("_pos") + 1).alias("step"), "ts", "revenue"), on="step")
    return ev.regression_metrics(j, "revenue", "forecast")


@register("arima_by_series")
def q_arima_by_series(spark, d):
    """H9 per series: ARIMA(p,1,q), p <= 3, q <= 1, and a 7-day forecast for each order priority's daily revenue."""
    s = S.daily_orders(spark, d, with_nulls=False)
    return FC.arima_forecast(s, "revenue", 7, by=["series"], max_p=3, d=1, max_q=1)


# ------------------------------------------------------------------------------------------- A9, H5, H14
@register("rf_mtry_tuning")
def q_rf_mtry_tuning(spark, d):
    """A9 + H5 + H14: forest over the mtry grid 1..7 (parameter grid), test RMSE per setting, best setting flagged."""
    from gustlab.sources.files import param_grid

    sp = _split(spark, d).cache()
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    grid = [r["mtry"] for r in param_grid(spark, mtry=list(range(1, len(X) + 1))).collect()]

    fits = M.fit_random_forests(train, Y, [dict(features=X, num_trees=20, mtry=m) for m in grid])

    def task(m, fm):
        def run():
            r = ev.regression_metrics(fm.predict(test), Y, "prediction").first()
            return (int(m), r["rmse"], r["mae"], r["r2_corr"])
        return run

    rows = M._run_parallel([task(m, fm) for m, fm in zip(grid, fits)], 4)
    res = spark.createDataFrame(rows, "mtry int, rmse double, mae double, r2_corr double")
    best = ev.best_setting(res.withColumn("model", F.lit("rf")), "model", "mtry", "rmse").first()["best_mtry"]
    return res.withColumn("best", F.col("mtry") == F.lit(best))


@register("arima_residual_check")
def q_arima_residual_check(spark, d):
    """E12 on residuals: Ljung-Box over 10 lags of the ARIMA fit's one-step residuals, MA terms included (fitted orders
    as dof); d by the KPSS test."""
    s = S.farm_series(spark, d)
    fit = FC.arima_fit(s, "revenue", max_p=5, d=FC.choose_d(s, "revenue"), max_q=2).cache()
    row = fit.first()
    p, q = row["p"] or 0, row["q"] or 0
    res = FC.arima_residuals(s, "revenue", fit)
    return tsx.ljung_box(tsx.acf(res, "resid", 10, order="_pos"), 10, fitted_params=p + q).withColumns(
        {"p_order": F.lit(p), "q_order": F.lit(q)})


@register("lagged_forecast_reference_mode")
def q_lagged_forecast_reference_mode(spark, d):
    """H8 + E4 (T12): the same forecast with the reference's level restoration, which adds the actual back
    in, so its error measures only the predicted difference (the basis of the reference's 0.8 % figure)."""
    scored = FC.lagged_forecast(_hourly(spark, d), "active_power_kw", FORECAST_X, "2024-01-20 00:00:00",
                                horizon=1, steps=3, train_days=7, val_days=1, test_days=1, model="gbt",
                                restore="reference", scale_on="all")
    return ev.regression_metrics(scored, "actual", "predicted")


# ------------------------------------------------------------------------------------------- H9: choice of d
@register("kpss_statistic", round_sql(f"""
    WITH s AS (SELECT revenue AS x, row_number() OVER (ORDER BY ts) AS i FROM ({S.FARM_SERIES_SQL})),
    d AS (SELECT i, x - avg(x) OVER () AS d, count(*) OVER () AS n FROM s),
    c AS (SELECT *, sum(d) OVER (ORDER BY i) AS s FROM d),
    l AS (SELECT CAST(trunc(4 * pow(max(n) / 100.0, 0.25)) AS INTEGER) AS lags FROM d),
    r AS (SELECT k.lag, sum(a.d * b.d) AS g FROM (SELECT unnest(range(1, 40)) AS lag) k, d a JOIN d b ON true
          WHERE b.i = a.i + k.lag GROUP BY k.lag),
    w AS (SELECT sum((1 - lag / (lags + 1.0)) * g) AS g FROM r, l WHERE lag <= lags)
    SELECT max(n) AS n, max(lags) AS lags, sum(s * s) / (max(n) * (sum(d * d) + 2 * max(w.g))) AS kpss FROM c, l, w
""", ["kpss"], 6))
def q_kpss_statistic(spark, d):
    """H9: the level statistic behind the choice of d, on the daily revenue series."""
    return present(FC.kpss(S.farm_series(spark, d), "revenue"), 6, ["kpss"])


# ------------------------------------------------------------------------------------------- entry 4
@register("season_regression")
def q_season_regression(spark, d):
    """Entry 4: chosen weeks -> selection -> split -> scaling -> forest, kernel and random-layer models, scored on the
    training and held-out rows and on another week."""
    from gustlab.plans.workflows import season_regression

    h = _hourly(spark, d).withColumn("filename", F.concat(F.lit("Wk"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
    return season_regression(h, "active_power_kw", "wind_speed_ms", S.SCADA_FEATURES, seasons=["Wk01", "Wk02", "Wk04"],
                             evaluate=["Wk03"])
