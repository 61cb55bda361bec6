"""Registered queries: audits, reshaping, joins and de-duplication (B, C1, C7, D3-D8, D11, D14, D20, E6, E7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.functions.columns import dms_to_decimal
from gustlab.operators import joins as J
from gustlab.operators import quality as Q
from gustlab.operators import reshape as R
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S
from gustlab.plans.catalog import HOURLY_SQL, register
from gustlab.sources.files import power_curve

FEATS = S.SCADA_FEATURES
SCADA_NULL = S.scada_10min_sql(with_nulls=True)
SCADA = S.scada_10min_sql()


def _list(fmt: str, cols=FEATS, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in cols)


# ------------------------------------------------------------------------------------------- D3, D4, B15
MISSING_SQL = f"""
    WITH s AS ({SCADA_NULL}),
    w AS (SELECT filename, {_list("round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 3) AS {c}")}
          FROM s GROUP BY filename)
    SELECT * FROM (UNPIVOT w ON {_list("{c}")} INTO NAME feature VALUE pct_missing)
"""


@register("missing_percent", MISSING_SQL)
def q_missing_percent(spark, d):
    """D3: percent NULL per feature per week label (timestamp and keys excluded, T2)."""
    return Q.missing_percent(S.scada_10min(spark, d, with_nulls=True), FEATS, by=["filename"])


@register("affected_months", f"""
    WITH m AS ({MISSING_SQL})
    SELECT filename, round_even(avg(pct_missing), 2) AS mean_pct_missing
    FROM m GROUP BY filename HAVING sum(pct_missing) <> 0
""")
def q_affected_months(spark, d):
    """Groups with any missing value, mean percent over features."""
    long = Q.missing_percent(S.scada_10min(spark, d, with_nulls=True), FEATS, by=["filename"])
    return Q.affected_groups(long, by="filename")


def _report_long(report):
    """The transposed report with its week columns back in rows, so any set of weeks compares."""
    weeks = [c for c in report.columns if c != "feature"]
    return R.unpivot_long(report, ["feature"], weeks, "filename", "pct_missing")


@register("missing_report", MISSING_SQL)
def q_missing_report(spark, d):
    """The percent table transposed, features as rows and one column per week label found in the data; the result
    lists the transposed table's cells."""
    long = Q.missing_percent(S.scada_10min(spark, d, with_nulls=True), FEATS, by=["filename"])
    return _report_long(Q.missing_report(long, "filename"))


# ------------------------------------------------------------------------------------------- D5
@register("missing_rows", f"""
    WITH s AS ({SCADA_NULL})
    SELECT filename,
           {_list("CAST(sum(CASE WHEN turbine = '{c}' THEN (CASE WHEN active_power_kw IS NULL THEN 1 ELSE 0 END) END) AS BIGINT) AS {c}", S.TURBINES)}
    FROM s GROUP BY filename
""")
def q_missing_rows(spark, d):
    """NULL power readings per week label and turbine."""
    return Q.missing_rows(S.scada_10min(spark, d, with_nulls=True), "active_power_kw", by="filename",
                          turbines=S.TURBINES)


# ------------------------------------------------------------------------------------------- D6
@register("duplicate_hours", f"""
    WITH h AS ({S.HOURLY_EVENTS_SQL}), g AS (SELECT ts, count(*) AS n FROM h GROUP BY ts HAVING count(*) > 1)
    SELECT count(*) AS n_duplicated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_surplus_rows FROM g
""")
def q_duplicate_hours(spark, d):
    """Hours that occur more than once in the left feed."""
    return Q.duplicate_keys(S.hourly_events(spark, d), ["ts"])


# ------------------------------------------------------------------------------------------- D7, D8, B4
EXTRA_COLS = FEATS + ["light_redux", "cpu_temp"]


def _scada_extra(spark, d):
    """scada_10min with a constant and an empty measure, as real exports carry."""
    return S.scada_10min(spark, d).withColumns({"light_redux": F.lit(0.0), "cpu_temp": F.lit(None).cast("double")})


SCADA_EXTRA_SQL = f"SELECT *, 0.0::DOUBLE AS light_redux, NULL::DOUBLE AS cpu_temp FROM ({SCADA})"


@register("zero_variance_columns", f"""
    WITH s AS ({SCADA_EXTRA_SQL}),
    g AS (SELECT filename, turbine,
                 {_list("min({c}) IS NOT DISTINCT FROM max({c}) AS {c}", EXTRA_COLS)}
          FROM s GROUP BY filename, turbine),
    u AS (UNPIVOT g ON {_list("{c}", EXTRA_COLS)} INTO NAME feature VALUE is_const)
    SELECT DISTINCT feature FROM u WHERE is_const
""")
def q_zero_variance_columns(spark, d):
    """Features constant within any week x turbine group (union over groups, T4)."""
    return Q.zero_variance(_scada_extra(spark, d), EXTRA_COLS, by=["filename", "turbine"])


@register("drop_constant_and_empty", f"""
    WITH s AS ({SCADA_EXTRA_SQL}),
    g AS (SELECT filename, turbine,
                 {_list("min({c}) IS NOT DISTINCT FROM max({c}) AS {c}", EXTRA_COLS)}
          FROM s GROUP BY filename, turbine),
    zv AS (SELECT DISTINCT feature FROM (UNPIVOT g ON {_list("{c}", EXTRA_COLS)} INTO NAME feature VALUE is_const)
           WHERE is_const),
    empty AS (SELECT feature FROM (UNPIVOT (SELECT {_list("count({c}) AS {c}", EXTRA_COLS)} FROM s)
                                   ON {_list("{c}", EXTRA_COLS)} INTO NAME feature VALUE n) WHERE n = 0),
    u AS (SELECT * FROM s UNPIVOT INCLUDE NULLS (value FOR feature IN ({_list("{c}", EXTRA_COLS)})))
    SELECT filename, turbine, ts, feature, value FROM u
    WHERE feature NOT IN (SELECT feature FROM zv) AND feature NOT IN (SELECT feature FROM empty)
""")
def q_drop_constant_and_empty(spark, d):
    """B4 + D8: drop all-NULL columns, then the zero-variance columns found by D7; the kept table in long form
    (one row per reading and kept feature), so the kept set may differ by input."""
    df = R.drop_all_null_columns(_scada_extra(spark, d))
    zv = Q.zero_variance(df, [c for c in EXTRA_COLS if c in df.columns], by=["filename", "turbine"])
    kept = Q.drop_columns(df, zv)
    feats = [c for c in kept.columns if c in EXTRA_COLS]
    return R.unpivot_long(kept, ["filename", "turbine", "ts"], feats, "feature", "value")


# ------------------------------------------------------------------------------------------- D11, D14, D20
@register("distinct_turbine_weeks", f"SELECT DISTINCT filename, turbine FROM ({SCADA})")
def q_distinct_turbine_weeks(spark, d):
    """Unique (week label, turbine) pairs."""
    return Q.distinct_values(S.scada_10min(spark, d), ["filename", "turbine"])


@register("any_null_by_week", f"""
    SELECT filename, bool_or({_list("{c} IS NULL", sep=" OR ")}) AS has_null FROM ({SCADA_NULL}) GROUP BY filename
""")
def q_any_null_by_week(spark, d):
    """Does any NULL remain, per week label."""
    return Q.any_null_by(S.scada_10min(spark, d, with_nulls=True), FEATS, by=["filename"])


@register("missingness_profile", f"""
    WITH s AS ({SCADA_NULL}),
    w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket,
                 {_list("avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}")}
          FROM s GROUP BY 1)
    SELECT * FROM (UNPIVOT w ON {_list("{c}")} INTO NAME feature VALUE null_share)
""")
def q_missingness_profile(spark, d):
    """NULL share per day and feature."""
    return Q.missingness_profile(S.scada_10min(spark, d, with_nulls=True), FEATS, bucket="1 day")


# ------------------------------------------------------------------------------------------- B10, B11, B9
@register("complete_rows", f"SELECT * FROM ({SCADA_NULL}) WHERE {_list('{c} IS NOT NULL', sep=' AND ')}")
def q_complete_rows(spark, d):
    """Rows with no NULL (complete cases)."""
    return R.complete_rows(S.scada_10min(spark, d, with_nulls=True))


@register("incomplete_rows", f"SELECT * FROM ({SCADA_NULL}) WHERE {_list('{c} IS NULL', sep=' OR ')}")
def q_incomplete_rows(spark, d):
    """Rows with at least one NULL."""
    return R.incomplete_rows(S.scada_10min(spark, d, with_nulls=True), FEATS)


@register("fill_constant", f"""
    SELECT filename, turbine, ts, coalesce(active_power_kw, 0.0) AS active_power_kw,
           coalesce(wind_speed_ms, 0.0) AS wind_speed_ms, hub_temp_c, temp_rotor_bearing_c,
           coalesce(rotor_speed_rpm, 0.0) AS rotor_speed_rpm, blade_angle
    FROM ({SCADA_NULL})
""")
def q_fill_constant(spark, d):
    """NULL -> 0 (as done for precipitation)."""
    return R.fill_constant(S.scada_10min(spark, d, with_nulls=True),
                           ["active_power_kw", "wind_speed_ms", "rotor_speed_rpm"], 0.0)


# ------------------------------------------------------------------------------------------- B3, B16
@register("parse_text_numbers", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
           round(l_quantity, 1) AS l_quantity, l_discount, l_returnflag
    FROM lineitem
""")
def q_parse_text_numbers(spark, d):
    """B3 + B16: text with thousands marks and bad cells -> doubles; the flag column stays text."""
    return R.cast_numeric(S.text_numbers(spark, d), exclude=["l_returnflag"])


# ------------------------------------------------------------------------------------------- B21
@register("dms_coordinates", """
    SELECT s_suppkey,
           (CASE WHEN s_acctbal < 0 THEN -1 ELSE 1 END) *
           (floor(abs(s_acctbal) / 100) % 90 + (floor(abs(s_acctbal)) % 60) / 60.0
            + round((abs(s_acctbal) * 100) % 6000 / 100.0, 2) / 3600.0) AS lat_decimal
    FROM supplier
""")
def q_dms_coordinates(spark, d):
    """B21: 'deg min sec' text (built from supplier balances) -> decimal degrees."""
    s = S.table(spark, d, "supplier")
    a = F.abs("s_acctbal")
    deg = (F.floor(a / 100) % 90).cast("long")
    mins = (F.floor(a) % 60).cast("long")
    secs = F.round((a * 100) % 6000 / 100.0, 2)
    sign = F.when(F.col("s_acctbal") < 0, F.lit("-")).otherwise(F.lit(""))
    txt = F.concat(sign, deg.cast("string"), F.lit(" "), mins.cast("string"), F.lit(" "), secs.cast("string"))
    return s.select("s_suppkey", dms_to_decimal(txt).alias("lat_decimal"))


# ------------------------------------------------------------------------------------------- B14
@register("unpivot_features", f"""
    SELECT filename, turbine, ts, var, val FROM (UNPIVOT ({SCADA}) ON {_list("{c}")} INTO NAME var VALUE val)
""")
def q_unpivot_features(spark, d):
    """Wide -> (var, val) long rows."""
    return R.unpivot_long(S.scada_10min(spark, d), ["filename", "turbine", "ts"], FEATS)


# ------------------------------------------------------------------------------------------- C1
WEATHER_COLS = S.WEATHER_FEATURES


@register("join_weather", f"""
    WITH h AS ({HOURLY_SQL.replace("{agg}", "max")}), w AS ({S.WEATHER_HOURLY_SQL})
    SELECT h.*, w.month_label, {_list("w.{c}", WEATHER_COLS)} FROM h LEFT JOIN w ON h.ts = w.ts
""")
def q_join_weather(spark, d):
    """Hourly farm table left-joined with the hourly weather feed."""
    h = tsx.hourly_farm(S.scada_10min(spark, d), FEATS, turbines=S.TURBINES)
    return J.join_weather(h, S.weather_hourly(spark, d))


# ------------------------------------------------------------------------------------------- E6, E7
@register("dedupe_keep_max", f"""
    SELECT ts, active_power_kw, filename, n_events FROM (
      SELECT *, row_number() OVER (PARTITION BY ts ORDER BY active_power_kw DESC, filename DESC, n_events DESC) AS rn
      FROM ({S.HOURLY_EVENTS_SQL})) WHERE rn = 1
""")
def q_dedupe_keep_max(spark, d):
    """One row per hour, the highest power."""
    return J.dedupe_keep_max(S.hourly_events(spark, d), ["ts"], "active_power_kw")


@register("dedupe_keep_first", f"""
    SELECT ts, filename, active_power_kw, n_events FROM (
      SELECT *, row_number() OVER (PARTITION BY ts ORDER BY filename, active_power_kw, n_events) AS rn
      FROM ({S.HOURLY_EVENTS_SQL})) WHERE rn = 1
""")
def q_dedupe_keep_first(spark, d):
    """One row per hour, the first by file name (explicit order; Spark keeps no file order)."""
    return J.dedupe_keep_first(S.hourly_events(spark, d), ["ts"], ["filename"])


# ------------------------------------------------------------------------------------------- C7, A8
# The curve's 43 points, typed here apart from the library's own table.
_CURVE_VALUES = """
    (4.0, 75.0), (4.5, 170.0), (5.0, 275.0), (5.5, 380.0), (6.0, 527.0), (6.5, 827.0), (7.0, 1126.0),
    (7.5, 1412.0), (8.0, 1698.0), (8.5, 1968.0), (9.0, 2237.0), (9.5, 2476.0), (10.0, 2715.0), (10.5,
    2911.0), (11.0, 3106.0), (11.5, 3200.0), (12.0, 3285.0), (12.5, 3360.0), (13.0, 3400.0), (13.5,
    3400.0), (14.0, 3400.0), (14.5, 3400.0), (15.0, 3400.0), (15.5, 3400.0), (16.0, 3400.0), (16.5,
    3400.0), (17.0, 3400.0), (17.5, 3400.0), (18.0, 3400.0), (18.5, 3400.0), (19.0, 3400.0), (19.5,
    3400.0), (20.0, 3400.0), (20.5, 3400.0), (21.0, 3400.0), (21.5, 3400.0), (22.0, 3400.0), (22.5,
    3400.0), (23.0, 3400.0), (23.5, 3400.0), (24.0, 3400.0), (24.5, 3400.0), (25.0, 3400.0)
"""


@register("expected_power", f"""
    WITH c AS (SELECT * FROM (VALUES {_CURVE_VALUES}) t(x0, y0)),
    seg AS (SELECT x0, y0, lead(x0) OVER (ORDER BY x0) AS x1, lead(y0) OVER (ORDER BY x0) AS y1 FROM c),
    s AS ({SCADA})
    SELECT s.*, seg.y0 + (CASE WHEN seg.x1 > seg.x0 THEN (s.wind_speed_ms - seg.x0) / (seg.x1 - seg.x0) ELSE 0.0 END)
                 * (coalesce(seg.y1, seg.y0) - seg.y0) AS expected_power,
           s.active_power_kw - (seg.y0 + (CASE WHEN seg.x1 > seg.x0 THEN (s.wind_speed_ms - seg.x0) / (seg.x1 - seg.x0) ELSE 0.0 END)
                 * (coalesce(seg.y1, seg.y0) - seg.y0)) AS power_deviation,
           (s.active_power_kw >= (seg.y0 + (CASE WHEN seg.x1 > seg.x0 THEN (s.wind_speed_ms - seg.x0) / (seg.x1 - seg.x0) ELSE 0.0 END)
                 * (coalesce(seg.y1, seg.y0) - seg.y0)) * 0.8
            AND s.active_power_kw <= (seg.y0 + (CASE WHEN seg.x1 > seg.x0 THEN (s.wind_speed_ms - seg.x0) / (seg.x1 - seg.x0) ELSE 0.0 END)
                 * (coalesce(seg.y1, seg.y0) - seg.y0)) * 1.2) AS in_band
    FROM s LEFT JOIN seg ON (s.wind_speed_ms >= seg.x0 AND s.wind_speed_ms < seg.x1)
                         OR (seg.x1 IS NULL AND s.wind_speed_ms = seg.x0)
""")
def q_expected_power(spark, d):
    """C7 + A8: nominal power at each reading's wind speed (linear on the 43-point curve), deviation, ±20 % flag."""
    return J.expected_power(S.scada_10min(spark, d), power_curve(spark))


# ------------------------------------------------------------------------------------------- A7
@register("missing_report_csv", MISSING_SQL)
def q_missing_report_csv(spark, d):
    """The missing-value report written as one CSV file in the shared folder and read back."""
    from gustlab.session import scratch_path
    from gustlab.sources.files import write_report

    long = Q.missing_percent(S.scada_10min(spark, d, with_nulls=True), FEATS, by=["filename"])
    path = write_report(Q.missing_report(long, "filename"), scratch_path(spark, "miss-vals"))
    back = spark.read.option("header", True).csv(path)
    back = back.select("feature", *[F.col(c).cast("double").alias(c) for c in back.columns if c != "feature"])
    return _report_long(back)
