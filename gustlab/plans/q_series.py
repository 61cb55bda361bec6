"""Registered queries on whole series: all lags of the autocorrelation, exact-likelihood ARIMA, rolling origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import likelihood as LK
from gustlab.operators import reservoir as RS
from gustlab.operators import rolling, spectrum
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S
from gustlab.plans.catalog import HOURLY_SQL, present, register, round_sql

HOURLY = HOURLY_SQL.replace("{agg}", "max")


def _hourly(spark, d):
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES)


def _acf_sql(series: str) -> str:
    """All lags by the sum over pairs; ``series`` gives (k, i, x)."""
    return f"""
    WITH s AS ({series}),
    d AS (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS d, count(*) OVER (PARTITION BY k) AS n FROM s),
    den AS (SELECT k, sum(d * d) AS den, max(n) AS n FROM d GROUP BY k),
    num AS (SELECT a.k, b.i - a.i AS lag, sum(a.d * b.d) AS num FROM d a JOIN d b ON a.k = b.k AND a.i <= b.i GROUP BY 1, 2)
    SELECT num.k AS series, CAST(lag AS BIGINT) AS lag, num / den AS acf, 1.959963984540054 / sqrt(n) AS ci, n
    FROM num JOIN den ON num.k = den.k
"""


# ------------------------------------------------------------------------------------------- E10
@register("acf_all_lags_power", round_sql(_acf_sql(f"""
    SELECT 'level' AS k, row_number() OVER (ORDER BY ts) AS i, active_power_kw AS x FROM ({HOURLY})
    UNION ALL SELECT 'difference', row_number() OVER (ORDER BY ts), x FROM (
        SELECT ts, active_power_kw - lead(active_power_kw) OVER (ORDER BY ts) AS x FROM ({HOURLY})) WHERE x IS NOT NULL
"""), ["acf", "ci"], 7))
def q_acf_all_lags_power(spark, d):
    """All lags of the hourly farm power and of its difference, as two series of one job."""
    h = _hourly(spark, d).select("ts", "active_power_kw").cache()
    diff = tsx.lead_value(h, "active_power_kw", 1, out="next").select(
        F.lit("difference").alias("series"), "ts", (F.col("active_power_kw") - F.col("next")).alias("x"))
    both = h.select(F.lit("level").alias("series"), "ts", F.col("active_power_kw").alias("x")).unionAll(diff)
    return present(spectrum.acf_full(both, "x", by=["series"]).drop("significant"), 7, ["acf", "ci"])


@register("acf_all_lags_revenue", round_sql(_acf_sql(f"""
    SELECT 'revenue' AS k, row_number() OVER (ORDER BY ts) AS i, revenue AS x FROM ({S.FARM_SERIES_SQL})
"""), ["acf", "ci"], 7))
def q_acf_all_lags_revenue(spark, d):
    """All lags of the daily revenue (some 2,400 days) from one transform."""
    got = spectrum.acf_full(S.farm_series(spark, d), "revenue").withColumn("series", F.lit("revenue"))
    return present(got.drop("significant"), 7, ["acf", "ci"])


# ------------------------------------------------------------------------------------------- H16
ROLL_X = ["wind_speed_ms", "temp_rotor_bearing_c", "hub_temp_c"]


@register("rolling_origin_backtest")
def q_rolling_origin_backtest(spark, d):
    """Every day an origin, horizons 1 to 48 hours, a week of training before each; metrics per cell."""
    return rolling.rolling_backtest(_hourly(spark, d), "active_power_kw", ROLL_X, range(1, 49))


@register("rolling_origin_persistence", round_sql(f"""
    WITH h AS ({HOURLY}),
    r AS (SELECT a.ts, a.active_power_kw AS x FROM h a JOIN h b ON b.ts = a.ts - INTERVAL 1 HOUR JOIN h c ON c.ts = a.ts - INTERVAL 2 HOUR
          WHERE a.active_power_kw IS NOT NULL AND {" AND ".join(f"{t}.{c} IS NOT NULL" for t in "abc" for c in ROLL_X)}),
    p AS (SELECT r.ts, r.x, k.horizon, l.ts AS label_ts, l.active_power_kw AS y
          FROM r, (SELECT CAST(unnest(range(1, 49)) AS INTEGER) AS horizon) k, h l
          WHERE l.ts = r.ts + k.horizon * INTERVAL 1 HOUR AND l.active_power_kw IS NOT NULL),
    o AS (SELECT DISTINCT CAST(ts AS DATE) AS origin FROM r),
    n AS (SELECT o.origin, p.horizon, count(*) AS n_train FROM o JOIN p ON p.label_ts < o.origin AND p.label_ts >= o.origin - INTERVAL 7 DAY
          GROUP BY 1, 2)
    SELECT n.origin, n.horizon, n.n_train, count(*) AS n, avg(abs(x - y)) AS mae_persistence, sqrt(avg((x - y) * (x - y))) AS rmse_persistence
    FROM n JOIN p ON p.horizon = n.horizon AND CAST(p.ts AS DATE) = n.origin WHERE n.n_train >= 24 GROUP BY 1, 2, 3
""", ["mae_persistence", "rmse_persistence"], 6))
def q_rolling_origin_persistence(spark, d):
    """The cells of the rolling back-test with their training and test rows, scored by persistence."""
    got = rolling.rolling_backtest(_hourly(spark, d), "active_power_kw", ROLL_X, range(1, 49), units=8)
    return present(got.select("origin", "horizon", "n_train", "n", "mae_persistence", "rmse_persistence"), 6)


# ------------------------------------------------------------------------------------------- H9
_SCALED = f"""
    SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, count(*) OVER (PARTITION BY series) AS n,
           (revenue - avg(revenue) OVER (PARTITION BY series)) / stddev_pop(revenue) OVER (PARTITION BY series) AS y
    FROM ({S.daily_orders_sql(with_nulls=False)})
"""
_AR1_SUMS = f"""
    WITH RECURSIVE s AS ({_SCALED}),
    l AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY i) AS p FROM s),
    m AS (SELECT series, max(n) AS n, sum(y * y) AS a, sum(y * p) AS c, sum(CASE WHEN i > 1 AND i < n THEN y * y ELSE 0 END) AS b,
                 max(CASE WHEN i = n THEN y END) AS last FROM l GROUP BY series)
"""


def _scaled(spark, d):
    s = S.daily_orders(spark, d, with_nulls=False)
    m = s.groupBy("series").agg(F.avg("revenue").alias("m"), F.stddev_pop("revenue").alias("sd"))
    return s.join(m, "series").select("series", "ts", ((F.col("revenue") - F.col("m")) / F.col("sd")).alias("y"))


@register("arima_ar1_likelihood", round_sql(f"""
    {_AR1_SUMS},
    g AS (SELECT m.*, k.setting, k.phi FROM m, (VALUES (0, -0.5::DOUBLE), (1, 0.0), (2, 0.3), (3, 0.9)) k(setting, phi)),
    v AS (SELECT *, (a - 2 * phi * c + phi * phi * b) / n AS sigma2 FROM g)
    SELECT series, CAST(setting AS INTEGER) AS setting, sigma2, -0.5 * n * (ln(2 * pi() * sigma2) + 1) + 0.5 * ln(1 - phi * phi) AS loglik, n FROM v
""", ["sigma2", "loglik"], 6))
def q_arima_ar1_likelihood(spark, d):
    """H9: the exact likelihood of each priority's daily revenue (standardised) under four autoregressions, by the filter."""
    got = LK.likelihood(_scaled(spark, d), "y", [((-0.5,), ()), ((), ()), ((0.3,), ()), ((0.9,), ())], by=["series"])
    return present(got, 6, ["sigma2", "loglik"])


def _no_minus_zero(sql: str, cols) -> str:
    """Far forecasts round to zero, of either sign in either engine."""
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c} END AS {c}' for c in cols)}) FROM ({sql})"


@register("arima_ar1_intervals", _no_minus_zero(round_sql(f"""
    {_AR1_SUMS},
    z AS (SELECT series, n, a, b, c, last, 0 AS k, -0.99999::DOUBLE AS lo, 0.99999::DOUBLE AS hi FROM m
          UNION ALL SELECT series, n, a, b, c, last, k + 1,
              CASE WHEN n * (c - (lo + hi) / 2 * b) * (1 - pow((lo + hi) / 2, 2)) > (lo + hi) / 2 * (a - (lo + hi) * c + pow((lo + hi) / 2, 2) * b)
                   THEN (lo + hi) / 2 ELSE lo END,
              CASE WHEN n * (c - (lo + hi) / 2 * b) * (1 - pow((lo + hi) / 2, 2)) > (lo + hi) / 2 * (a - (lo + hi) * c + pow((lo + hi) / 2, 2) * b)
                   THEN hi ELSE (lo + hi) / 2 END FROM z WHERE k < 60),
    f AS (SELECT series, n, last, (lo + hi) / 2 AS phi, (a - (lo + hi) * c + pow((lo + hi) / 2, 2) * b) / n AS sigma2 FROM z WHERE k = 60),
    h AS (SELECT f.*, k.step, pow(phi, k.step) * last AS forecast, sqrt(sigma2 * (1 - pow(phi, 2 * k.step)) / (1 - phi * phi)) AS se
          FROM f, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step) k)
    SELECT series, phi, sigma2, -0.5 * n * (ln(2 * pi() * sigma2) + 1) + 0.5 * ln(1 - phi * phi) AS loglik, step, forecast, se,
           forecast - 1.2815515655446004 * se AS lo80, forecast + 1.2815515655446004 * se AS hi80,
           forecast - 1.959963984540054 * se AS lo95, forecast + 1.959963984540054 * se AS hi95 FROM h
""", ["phi", "sigma2", "loglik", "forecast", "se", "lo80", "hi80", "lo95", "hi95"], 5), ["phi", "forecast"]))
def q_arima_ar1_intervals(spark, d):
    """H9: AR(1) of largest likelihood for each priority's daily revenue (standardised), seven forecasts with 80 and 95 %
    bounds; the SQL finds the root of the likelihood's derivative."""
    fit = LK.auto_arima(_scaled(spark, d), "y", h=7, by=["series"], order=(1, 0), d=0, constant=False)
    got = fit.select("series", F.element_at("phi", 1).alias("phi"), "sigma2", "loglik", F.explode("forecasts").alias("f")).select(
        "series", "phi", "sigma2", "loglik", "f.*")
    got = present(got, 5)
    return got.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("phi", "forecast")})


@register("arima_search_by_series")
def q_arima_search_by_series(spark, d):
    """H9: orders, d and drift searched for each priority's daily revenue by exact likelihood, with a week of forecasts and their
    80 and 95 % bounds."""
    fit = LK.auto_arima(S.daily_orders(spark, d, with_nulls=False), "revenue", h=7, by=["series"], max_p=3, max_q=3)
    return fit.select("series", "p", "d", "q", "constant", "sigma2", "loglik", "aicc", F.explode("forecasts").alias("f")).select(
        "series", "p", "d", "q", "constant", "sigma2", "loglik", "aicc", "f.*")


@register("arima_search_forecast")
def q_arima_search_forecast(spark, d):
    """H9: the search on daily revenue before 2001 (p, q <= 5, d <= 2); the next 30 days scored, with the share that lies within
    the 80 and 95 % bounds."""
    s = S.farm_series(spark, d)
    cut = F.lit("2001-01-01").cast("timestamp_ntz")
    fc = LK.forecasts(LK.auto_arima(s.filter(F.col("ts") < cut), "revenue", h=30))
    test = tsx.sequence_index(s.filter(F.col("ts") >= cut), "ts").select((F.col("_pos") + 1).alias("step"), "revenue")
    j = fc.join(test, on="step")
    inside = lambda a, b: F.avg(F.col("revenue").between(F.col(a), F.col(b)).cast("double"))
    return j.groupBy("p", "d", "q").agg(*ev.metric_columns(F.col("revenue"), F.col("forecast")), inside("lo80", "hi80").alias("inside80"),
                                        inside("lo95", "hi95").alias("inside95"))


# ------------------------------------------------------------------------------------------- H8
@register("reservoir_forecast_metrics")
def q_reservoir_forecast_metrics(spark, d):
    """H8: one hour ahead from an echo-state reservoir over the whole history, scored from 20 January on."""
    got = RS.reservoir_forecast(_hourly(spark, d), "active_power_kw", ROLL_X, "2024-01-20 00:00:00", washout=100)
    return ev.regression_metrics(got, "actual", "predicted")
