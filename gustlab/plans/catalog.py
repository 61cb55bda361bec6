"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle where SQL can express it.

Every query reads the driver tables through :mod:`gustlab.plans.standins` and runs the library operator on all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ("q_quality", "q_impute", "q_sources", "q_stats", "q_models", "q_checked", "q_series", "q_forest")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def present(df: DataFrame, digits: int, cols=None) -> DataFrame:
    """Round float outputs half-even for comparison with another engine (summation order differs in the last bits).

    Applied by the registered queries only; the library operators return full precision.
    """
    cols = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.bround(F.col(c), digits) for c in cols})


def round_sql(sql: str, cols, digits: int) -> str:
    """The SQL twin of :func:`present`: ``round_even`` on the named columns of ``sql``'s result."""
    repl = ", ".join(f"round_even({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql})"


METRIC_COLS = ["mae", "rmse", "mape", "r2", "r2_corr", "mean_error_pct"]


def _feat_sql(fmt: str, feats=S.SCADA_FEATURES) -> str:
    return ",\n           ".join(fmt.format(c=c) for c in feats)


SCADA = S.scada_10min_sql()
HOURLY_SQL = f"""
    WITH s AS ({SCADA}),
    t AS (SELECT turbine, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
           {_feat_sql('avg({c}) AS {c}')}
          FROM s GROUP BY 1, 2)
    SELECT ts, {_feat_sql('round_even({{agg}}({c}), 3) AS {c}')}
    FROM t GROUP BY ts
"""


# ------------------------------------------------------------------------------------------- D1, D2
@register("hourly_farm_max", HOURLY_SQL.replace("{agg}", "max"))
def q_hourly_farm_max(spark, d):
    """Per-turbine hourly mean, then max over turbines, rounded half-even to 3 places."""
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES, farm_agg="max")


@register("hourly_farm_mean", HOURLY_SQL.replace("{agg}", "avg"))
def q_hourly_farm_mean(spark, d):
    """Per-turbine hourly mean, then mean over turbines."""
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, turbines=S.TURBINES, farm_agg="mean")


@register("hourly_farm_two_stage", HOURLY_SQL.replace("{agg}", "max"))
def q_hourly_farm_two_stage(spark, d):
    """D1 through the general two-aggregation plan (turbine list not known up front)."""
    return tsx.hourly_farm(S.scada_10min(spark, d), S.SCADA_FEATURES, farm_agg="max")


# ------------------------------------------------------------------------------------------- flagship
def persistence_forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Minimum slice: 10-min turbine rows -> hourly farm (D1) -> difference (E3) -> causal undifference of the
    persistence forecast (E4, predicted difference 0) -> metrics (H13)."""
    hourly = tsx.hourly_farm(S.scada_10min(spark, d), ["active_power_kw"], turbines=S.TURBINES)
    diffed = tsx.difference(hourly, "active_power_kw", k=1, lead_col="power_lead", diff_col="power_diff")
    fc = diffed.withColumn("pred_diff", F.lit(0.0))
    scored = tsx.undifference(fc, "pred_diff", "active_power_kw", "power_lead", k=1, mode="causal")
    return present(ev.regression_metrics(scored, "active_power_kw", "predicted_power"), 6)


_METRICS_SQL = """
    count(*) AS n,
    avg(abs(pred - act)) AS mae,
    sqrt(avg((pred - act) * (pred - act))) AS rmse,
    avg(CASE WHEN act <> 0 THEN abs((pred - act) / act) END) * 100 AS mape,
    count(*) FILTER (WHERE act = 0) AS n_zero,
    1 - sum((pred - act) * (pred - act)) / (var_pop(act) * count(*) + 1e-7) AS r2,
    pow(corr(act, pred), 2) AS r2_corr,
    sqrt(avg((pred - act) * (pred - act))) / avg(act) * 100 AS mean_error_pct
"""

register("persistence_forecast_metrics", round_sql(f"""
    WITH s AS ({SCADA}),
    t AS (SELECT turbine, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(active_power_kw) AS p FROM s GROUP BY 1, 2),
    h AS (SELECT ts, round_even(max(p), 3) AS act FROM t GROUP BY ts),
    f AS (SELECT act, lag(act, 1) OVER (ORDER BY ts) AS pred FROM h)
    SELECT {_METRICS_SQL} FROM f WHERE pred IS NOT NULL
""", METRIC_COLS, 6))(persistence_forecast_metrics)


# ------------------------------------------------------------------------------------------- E1-E3
@register("power_lead_difference", f"""
    WITH s AS ({SCADA}),
    t AS (SELECT turbine, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(active_power_kw) AS p FROM s GROUP BY 1, 2),
    h AS (SELECT ts, round_even(max(p), 3) AS active_power_kw FROM t GROUP BY ts)
    SELECT ts, active_power_kw,
           coalesce(lead(active_power_kw, 1) OVER w, first_value(active_power_kw) OVER w) AS power_lead,
           active_power_kw - coalesce(lead(active_power_kw, 1) OVER w, first_value(active_power_kw) OVER w)
             AS power_diff,
           lag(active_power_kw, 2) OVER w AS power_lag2
    FROM h WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def q_power_lead_difference(spark, d):
    """E1 (lead with wrap, T10), E2 (lag), E3 (difference) on the hourly farm series."""
    hourly = tsx.hourly_farm(S.scada_10min(spark, d), ["active_power_kw"], turbines=S.TURBINES)
    out = tsx.difference(hourly, "active_power_kw", 1, lead_col="power_lead", diff_col="power_diff")
    out = tsx.lag_value(out, "active_power_kw", 2, out="power_lag2")
    return out.select("ts", "active_power_kw", "power_lead", "power_diff", "power_lag2")


def load_all() -> None:
    """Import the query modules so their ``register`` calls run."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"gustlab.plans.{m}")
