"""Registered queries that hold grid, assembly, comparison, summary and order-search operators against SQL (A8, A9, B18, C6,
H9, H14, H15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import forecast as FC
from gustlab.operators import impute as I
from gustlab.operators import reshape as R
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S
from gustlab.plans.catalog import HOURLY_SQL, _METRICS_SQL, present, register, round_sql
from gustlab.plans.q_quality import _CURVE_VALUES
from gustlab.sources import files as SRC

HOURLY = HOURLY_SQL.replace("{agg}", "max")


def _hourly(spark, d):
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES)


# ------------------------------------------------------------------------------------------- A8
@register("curve_band", round_sql(f"""
    WITH c AS (SELECT wind_speed::DOUBLE AS wind_speed, power::DOUBLE AS power FROM (VALUES {_CURVE_VALUES}) t(wind_speed, power)), s AS ({S.scada_10min_sql()})
    SELECT c.wind_speed, c.power * 0.8 AS lo20, c.power * 1.2 AS hi20, count(*) AS n_readings
    FROM c JOIN s ON floor(s.wind_speed_ms * 2) / 2 = c.wind_speed GROUP BY 1, 2, 3
""", ["lo20", "hi20"], 6))
def q_curve_band(spark, d):
    """The curve's points with their ±20 % band, and the readings that fall to each."""
    s = S.scada_10min(spark, d).select((F.floor(F.col("wind_speed_ms") * 2) / 2).alias("wind_speed"))
    c = SRC.power_curve(spark).select("wind_speed", "lo20", "hi20")
    return present(s.join(c, "wind_speed").groupBy("wind_speed", "lo20", "hi20").agg(F.count(F.lit(1)).alias("n_readings")), 6, ["lo20", "hi20"])


# ------------------------------------------------------------------------------------------- A9
@register("parameter_grid", """
    SELECT CAST(q AS INTEGER) AS min_qty, d AS max_discount, count(*) FILTER (WHERE l_quantity >= q AND l_discount <= d) AS n
    FROM lineitem, (SELECT unnest([10, 20, 30]) AS q), (SELECT unnest([0.015::DOUBLE, 0.045::DOUBLE]) AS d) GROUP BY 1, 2
""")
def q_parameter_grid(spark, d):
    """Every setting of a two-way grid, with the order lines that meet it (one pass, a counter a setting)."""
    grid = SRC.param_grid(spark, min_qty=[10, 20, 30], max_discount=[0.015, 0.045]).collect()  # a line a setting
    li = S.table(spark, d, "lineitem")
    counts = [F.count(F.when((F.col("l_quantity") >= g["min_qty"]) & (F.col("l_discount") <= g["max_discount"]), 1)) for g in grid]
    cells = F.array(*[F.struct(F.lit(g["min_qty"]).alias("min_qty"), F.lit(g["max_discount"]).alias("max_discount"), c.alias("n"))
                      for g, c in zip(grid, counts)])
    return li.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


# ------------------------------------------------------------------------------------------- B18
@register("assembled_vectors", round_sql("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 4 AS width, l_quantity AS first_value,
           l_quantity + l_extendedprice + l_discount + l_tax AS total FROM lineitem
""", ["total"], 4))
def q_assembled_vectors(spark, d):
    """Four columns assembled into one vector a row; its width, first entry and sum."""
    from pyspark.ml.functions import vector_to_array

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    v = R.assemble(S.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], out="v")
    v = v.select(*keys, vector_to_array("v").alias("a"))
    return present(v.select(*keys, F.size("a").alias("width"), F.element_at("a", 1).alias("first_value"),
                            F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total")), 4, ["total"])


# ------------------------------------------------------------------------------------------- C6, H15
@register("compare_line_fits", f"""
    WITH w AS ({S.WEATHER_HOURLY_SQL}), g AS (SELECT * FROM w WHERE wind_gust IS NOT NULL),
    a AS (SELECT regr_intercept(wind_gust, wind_speed) AS i, regr_slope(wind_gust, wind_speed) AS s FROM g),
    b AS (SELECT regr_intercept(wind_gust, humidity) AS i, regr_slope(wind_gust, humidity) AS s FROM g)
    SELECT ts, wind_gust, round_even(a.i + a.s * wind_speed, 6) AS pred_speed, round_even(b.i + b.s * humidity, 6) AS pred_humidity
    FROM g, a, b
""")
def q_compare_line_fits(spark, d):
    """C6 + H15: two fitted lines' predictions beside the actual gust, bound by the hour."""
    g = S.weather_hourly(spark, d).filter(F.col("wind_gust").isNotNull())
    preds = {}
    for name, x in (("speed", "wind_speed"), ("humidity", "humidity")):
        a, b = I.fit_line(g, "wind_gust", x)
        preds[name] = g.select("ts", F.bround(F.lit(a) + F.lit(b) * F.col(x), 6).alias("prediction"))
    return ev.compare_models(g.select("ts", "wind_gust"), ["ts"], preds)


# ------------------------------------------------------------------------------------------- H14
_LAG_METRICS_SQL = f"""
    WITH h AS ({HOURLY}),
    f AS (SELECT k, 'Wk' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, active_power_kw AS act,
                 lag(active_power_kw, k) OVER (PARTITION BY k ORDER BY ts) AS pred
          FROM h, (SELECT unnest([1, 2, 24]) AS k)),
    m AS (SELECT k, week, {_METRICS_SQL} FROM f WHERE pred IS NOT NULL GROUP BY k, week)
"""


def _lag_metrics(spark, d):
    h = _hourly(spark, d).select("ts", "active_power_kw")
    out = []
    for k in (1, 2, 24):
        p = tsx.lag_value(h, "active_power_kw", k, out="pred").filter(F.col("pred").isNotNull())
        p = p.withColumn("week", F.concat(F.lit("Wk"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
        out.append(ev.regression_metrics(p, "active_power_kw", "pred", by=["week"]).select(
            F.lit("persistence").alias("model"), F.lit(k).alias("setting"), "*"))
    return R.union_all(out)


@register("resample_summary", round_sql(_LAG_METRICS_SQL + """
    SELECT 'persistence' AS model, k AS setting, min(rmse) AS rmse_min, quantile_cont(rmse, 0.25) AS rmse_q1, median(rmse) AS rmse_median,
           avg(rmse) AS rmse_mean, quantile_cont(rmse, 0.75) AS rmse_q3, max(rmse) AS rmse_max FROM m GROUP BY k
""", ["rmse_min", "rmse_q1", "rmse_median", "rmse_mean", "rmse_q3", "rmse_max"], 6))
def q_resample_summary(spark, d):
    """Quartile summary over the weeks of the errors of persistence forecasts 1, 2 and 24 hours back."""
    return present(ev.cv_summary(_lag_metrics(spark, d), "model", ("rmse",), "setting"), 6)


@register("best_setting", round_sql(_LAG_METRICS_SQL + """
    , s AS (SELECT k, avg(rmse) AS r FROM m GROUP BY k)
    SELECT 'persistence' AS model, min_by(k, r) AS best_setting, min(r) AS rmse_mean FROM s
""", ["rmse_mean"], 6))
def q_best_setting(spark, d):
    """The setting with the least mean error over the weeks."""
    return present(ev.best_setting(ev.cv_summary(_lag_metrics(spark, d), "model", ("rmse",), "setting")), 6)


# ------------------------------------------------------------------------------------------- H9
@register("arima_order_by_series", f"""
    WITH s AS ({S.daily_orders_sql(False)}),
    y AS (SELECT series, ts, revenue - lag(revenue) OVER w AS y FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
    l AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS l FROM y),
    c AS (SELECT * FROM l WHERE y IS NOT NULL AND l IS NOT NULL),
    f AS (SELECT series, count(*) AS n, avg(y) AS m, regr_intercept(y, l) AS i, regr_slope(y, l) AS b, regr_r2(y, l) AS r2,
                 var_pop(y) * count(*) AS sst FROM c GROUP BY series),
    a AS (SELECT *, n * (ln(2 * pi() * sst / n) + 1) + 4 + 12.0 / (n - 3) AS a0,
                 n * (ln(2 * pi() * sst * (1 - r2) / n) + 1) + 6 + 24.0 / (n - 4) AS a1 FROM f)
    SELECT series, CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS p, round_even(CASE WHEN a1 < a0 THEN i ELSE m END, 2) AS intercept,
           CASE WHEN a1 < a0 THEN round_even(b, 6) END AS ar1, round_even(least(a0, a1), 4) AS aicc, n FROM a
""")
def q_arima_order_by_series(spark, d):
    """H9: ARIMA(p,1,0), p <= 1 by AICc, for each order priority's daily revenue: order, coefficients and criterion."""
    fit = FC.arima_fit(S.daily_orders(spark, d, with_nulls=False), "revenue", by=["series"], max_p=1, d=1)
    return fit.select("series", "p", F.bround("intercept", 2).alias("intercept"),
                      F.bround(F.try_element_at("coefs", F.lit(1)), 6).alias("ar1"), F.bround("aicc", 4).alias("aicc"), "n")
