"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.functions.columns import parse_dmy_hm
from gustlab.operators import quality as Q
from gustlab.operators import reshape as R
from gustlab.operators import timeseries as tsx
from gustlab.plans import exports as X
from gustlab.plans import standins as S
from gustlab.plans.catalog import HOURLY_SQL, register
from gustlab.session import scratch_path
from gustlab.sources import files as SRC

FEATS = S.SCADA_FEATURES
SCADA = S.scada_10min_sql()


def _l(fmt, cols=FEATS, sep=", "):
    return sep.join(fmt.format(c=c) for c in cols)


LONG_FROM_EXPORT_SQL = f"""
    WITH s AS ({SCADA}), slots AS (SELECT DISTINCT filename, ts FROM s),
    t AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in S.TURBINES)}) v(turbine))
    SELECT slots.filename, t.turbine, slots.ts, round(s.active_power_kw * 10, 3) AS active_power_kw,
           {_l("s.{c}", FEATS[1:])}
    FROM slots, t LEFT JOIN s ON s.filename = slots.filename AND s.ts = slots.ts AND s.turbine = t.turbine
"""


def _to_long(wide, ts_col="timestamp"):
    """Wide all-text export rows -> typed long rows."""
    data = [c for c in wide.columns if c.startswith("WT")]
    w = wide.select("filename", ts_col, *data)
    long = R.turbines_to_long(w, ts_col, FEATS, n_turbines=len(S.TURBINES), labels=S.TURBINES, keep=["filename"])
    long = R.cast_numeric(long, FEATS)
    return long.select("filename", "turbine", parse_dmy_hm(F.col(ts_col)).alias("ts"), *FEATS)


@register("read_scada_csv", LONG_FROM_EXPORT_SQL)
def q_read_scada_csv(spark, d):
    """A1 + A5 + B1-B3: ';' exports with metadata trailers -> one typed row per turbine and slot."""
    root = X.write_scada_exports(spark, d)
    wide = SRC.read_scada(spark, root, label_regex=X.WEEK_DIR, label_is_month=False)
    return _to_long(wide)


@register("read_scada_exact_trailer", LONG_FROM_EXPORT_SQL)
def q_read_scada_exact_trailer(spark, d):
    """A1 exact mode (T1): drop exactly the last N lines of every file instead of testing timestamps."""
    root = X.write_scada_exports(spark, d)
    wide = SRC.read_scada(spark, f"{root}/*/*/*.csv", trailer_rows=X.TRAILER_LINES, label_regex=X.WEEK_DIR,
                          label_is_month=False)
    return _to_long(wide)


@register("read_scada_zip", LONG_FROM_EXPORT_SQL)
def q_read_scada_zip(spark, d):
    """A3: zipped exports read on the executors (each member a task), then the same reshaping."""
    zroot = X.write_scada_zips(spark, X.write_scada_exports(spark, d))
    lines = SRC.read_zipped_lines(spark, f"{zroot}/*.zip")
    wide = SRC.parse_delimited(lines, sep=";")
    wide = wide.filter(parse_dmy_hm(F.col("timestamp")).isNotNull()).withColumn(
        "filename", F.regexp_extract("source_archive", r"scada_(Wk\d\d)_", 1))
    return _to_long(wide)


def _weather(spark, d):
    root = X.write_weather_exports(spark, d)
    w = SRC.read_weather(spark, f"{root}/*/filename=*/*.csv", drop_pattern="precipt|precipa|ozone",
                         drop_cols=["summary", "icon", "cloudCover", "uvIndex"], label_regex=X.WEEK_DIR,
                         label_is_month=False)
    w = R.cast_numeric(w, [c for c in S.WEATHER_FEATURES if c in w.columns])
    return w.select("month_label", F.to_timestamp_ntz("time").alias("ts"), *S.WEATHER_FEATURES)


@register("read_weather_csv", X.weather_export_sql())
def q_read_weather_csv(spark, d):
    """A2 + A4 + B5 + F2: weather files whose headers differ (some lack pressure) -> one frame, absent columns
    NULL; ozone and summary columns dropped by pattern and name."""
    return _weather(spark, d)


@register("calendar_parts", f"""
    SELECT ts, {_l("{c}")}, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
           make_timestamp(year(ts), month(ts), day(ts), hour(ts), 0, 0.0) AS ts_rebuilt
    FROM ({HOURLY_SQL.replace("{agg}", "max")})
""")
def q_calendar_parts(spark, d):
    """B7 + B8: hourly table with year, month, day, hour split out, and the timestamp rebuilt from them."""
    from gustlab.functions.columns import split_timestamp, unite_timestamp

    h = tsx.hourly_farm(S.scada_10min(spark, d), FEATS, turbines=S.TURBINES)
    h = split_timestamp(h, "ts", parts=("year", "month", "day", "hour"))
    return h.withColumn("ts_rebuilt", unite_timestamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour")))


_WCOLS = ["ts"] + S.WEATHER_FEATURES


@register("file_audit", f"""
    WITH w AS ({X.weather_export_sql()})
    SELECT month_label, count(*) AS n_rows,
           CAST(len(list_filter([{_l("CASE WHEN count({c}) > 0 THEN '{c}' END", _WCOLS)}], lambda x: x IS NOT NULL)) AS BIGINT)
             AS n_columns,
           array_to_string(list_sort(list_filter([{_l("CASE WHEN count({c}) > 0 THEN '{c}' END", _WCOLS)}],
                                                 lambda x: x IS NOT NULL)), ',') AS column_names
    FROM w GROUP BY month_label
""")
def q_file_audit(spark, d):
    """Rows, populated columns and their names per weather file label."""
    return Q.file_audit(_weather(spark, d), "month_label", _WCOLS)


@register("save_load_roundtrip", f"""
    SELECT 'Wk' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS filename, *
    FROM ({HOURLY_SQL.replace("{agg}", "max")})
""")
def q_save_load_roundtrip(spark, d):
    """The hourly table written as Parquet partitioned by week label and read back."""
    h = tsx.hourly_farm(S.scada_10min(spark, d), FEATS, turbines=S.TURBINES)
    h = h.withColumn("filename", F.concat(F.lit("Wk"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
    path = SRC.save_dataset(h, scratch_path(spark, "hourly"), partition_by=["filename"])
    return SRC.load_dataset(spark, path).select("filename", "ts", *FEATS)


@register("date_spine_gaps", f"""
    WITH s AS ({SCADA}),
    sp AS (SELECT turbine, unnest(generate_series(min(ts), max(ts), INTERVAL 10 MINUTE)) AS ts FROM s GROUP BY turbine)
    SELECT sp.turbine, sp.ts FROM sp ANTI JOIN s ON s.turbine = sp.turbine AND s.ts = sp.ts
""")
def q_date_spine_gaps(spark, d):
    """A10: every 10-minute slot between each turbine's first and last reading that has no reading."""
    s = S.scada_10min(spark, d)
    spine = SRC.calendar_spine(s, "ts", "10 minutes", keys=["turbine"])
    return spine.join(s.select("turbine", "ts"), on=["turbine", "ts"], how="left_anti")


# ------------------------------------------------------------------------------------------- A4, A5
@register("month_files", """
    SELECT strftime(o_orderdate, '%b%Y') AS filename, count(*) AS n_orders, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM orders WHERE strftime(o_orderdate, '%b%Y') NOT IN ('Feb1995', 'Mar1996') GROUP BY 1
""")
def q_month_files(spark, d):
    """A4 + A5: orders exported to one folder a month (``MM-yyyy`` in the path) and read back: the month label comes from
    the path, two superseded months are excluded."""
    root = scratch_path(spark, "month-files")
    o = S.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM-yyyy").alias("export"))
    o.write.partitionBy("export").option("header", True).csv(root)
    back = spark.read.option("header", True).csv(f"{root}/*").select("o_orderkey", F.col("_metadata.file_path").alias("path"))
    back = back.withColumn("filename", SRC.file_label(F.col("path")))
    kept = SRC.exclude_files(back, ["Feb1995", "Mar1996"], "filename")
    k = F.col("o_orderkey").cast("long")
    return kept.groupBy("filename").agg(F.count(F.lit(1)).alias("n_orders"), F.min(k).alias("first_key"), F.max(k).alias("last_key"))


# ------------------------------------------------------------------------------------------- B6, B17, E5
@register("rows_any_of", """
    SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'PROMO') OR contains(p_type, 'MALL') OR contains(p_type, '.')
""")
def q_rows_any_of(spark, d):
    """Rows whose text contains any of the patterns, taken literally (a dot matches a dot)."""
    p = S.table(spark, d, "part")
    return p.filter(R.any_of(F.col("p_type"), ["PROMO", "MALL", "."])).select("p_partkey", "p_type")


@register("row_slice", f"""
    WITH h AS ({HOURLY_SQL.replace("{agg}", "max")})
    SELECT 'both' AS closed, ts, active_power_kw FROM h WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'
    UNION ALL
    SELECT 'neither', ts, active_power_kw FROM h WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'
""")
def q_row_slice(spark, d):
    """The hours between two timestamps, both ends taken or both left out."""
    h = tsx.hourly_farm(S.scada_10min(spark, d), FEATS, turbines=S.TURBINES).select("ts", "active_power_kw")
    parts = [R.row_slice(h, "2024-01-05 00:00:00", "2024-01-06 00:00:00", closed=c).select(F.lit(c).alias("closed"), "ts", "active_power_kw")
             for c in ("both", "neither")]
    return R.union_all(parts)


@register("multi_key_order", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) - 1 AS place FROM orders
""")
def q_multi_key_order(spark, d):
    """E5: place of every order when sorted by priority, then date, then key."""
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return tsx.sequence_index(o, "o_orderpriority", idx="place", tiebreak=["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", F.col("place").cast("long").alias("place"))


# ------------------------------------------------------------------------------------------- F3, F4
@register("union_distinct_hours", f"""
    WITH s AS ({SCADA})
    SELECT DISTINCT turbine, date_trunc('hour', ts) AS ts FROM s WHERE turbine IN ('WT01', 'WT02')
    UNION SELECT DISTINCT turbine, date_trunc('hour', ts) FROM s WHERE turbine IN ('WT02', 'WT03')
""")
def q_union_distinct_hours(spark, d):
    """combined unique turbine-hours of two overlapping feeds."""
    s = S.scada_10min(spark, d).select("turbine", F.window("ts", "1 hour").start.alias("ts"))
    return R.union_distinct([s.filter(F.col("turbine").isin("WT01", "WT02")), s.filter(F.col("turbine").isin("WT02", "WT03"))])


@register("split_complement", f"""
    SELECT turbine, ts FROM ({SCADA}) WHERE NOT (ts >= TIMESTAMP '2024-01-14 23:00:00' AND ts < TIMESTAMP '2024-01-21 23:00:00')
""")
def q_split_complement(spark, d):
    """the readings outside the training week of a date split, unlabelled ones included."""
    s = S.scada_10min(spark, d).select("turbine", "ts")
    split = tsx.temporal_split(s, "2024-01-22 00:00:00", train_days=7, test_days=3, horizon_hours=1)
    return R.complement(split, "split", "train").select("turbine", "ts")
