"""Stand-in inputs built from the driver tables.

The reference's raw data (turbine SCADA exports, weather files) is not public, so each operator runs on a
frame of the schema it expects, shaped from the driver tables. Every builder here only reshapes rows into that
schema; the operators do the work. Builders behind SQL-checked queries have a DuckDB twin (``*_SQL`` /
``*_sql()``) so the oracle reads the same input.

Missing values are injected by fixed rules on the source keys (the driver tables have no nulls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

TURBINES = ["WT01", "WT02", "WT03"]
SCADA_FEATURES = ["active_power_kw", "wind_speed_ms", "hub_temp_c", "temp_rotor_bearing_c",
                  "rotor_speed_rpm", "blade_angle"]
WEATHER_FEATURES = ["precip_intensity", "precip_probability", "temperature", "apparent_temperature",
                    "dew_point", "humidity", "pressure", "wind_speed", "wind_gust", "wind_bearing",
                    "visibility"]
WIDE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
                 "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(props: str = "props"):
    return F.regexp_extract(F.col(props), r'"k": (\d+)', 1).cast("double")


def _week_label(ts):
    return F.concat(F.lit("Wk"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def scada_10min(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    """Long SCADA: one row per turbine and 10-minute slot (events as turbine readings)."""
    ev = table(spark, sf_dir, "events")
    slot = F.window("ts", "10 minutes").start
    base = ev.select(
        F.concat(F.lit("WT0"), (F.col("user_id") % 3 + 1).cast("string")).alias("turbine"),
        slot.alias("ts"), "value", _k().alias("k"), "event_type", "event_id")
    feats = {
        # sqrt scalings keep stand-in values off short decimal grids, so half-even rounding of a
        # value never meets a decimal tie that binary doubles cannot represent (engines differ there).
        "active_power_kw": F.avg("value") * F.sqrt(F.lit(2.0)),
        "wind_speed_ms": F.sqrt(F.avg("k")),
        "hub_temp_c": (F.count(F.lit(1)) + 20).cast("double"),
        "temp_rotor_bearing_c": F.sqrt(F.max("k")) * 2.0 + 25.0,
        "rotor_speed_rpm": F.min("value") * F.sqrt(F.lit(2.0)) / 10.0,
        "blade_angle": F.sum(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)),
    }
    if with_nulls:
        # the group's smallest id picks the gaps: about 1 in m groups at any scale factor
        hole_a = F.min("event_id") % 17 == 0
        hole_b = F.min("event_id") % 23 == 0
        feats["active_power_kw"] = F.when(~hole_a, feats["active_power_kw"])
        feats["rotor_speed_rpm"] = F.when(~hole_a, feats["rotor_speed_rpm"])
        feats["wind_speed_ms"] = F.when(~hole_b, feats["wind_speed_ms"])
    out = base.groupBy("turbine", "ts").agg(*[v.alias(k) for k, v in feats.items()])
    return out.select(_week_label(F.col("ts")).alias("filename"), "turbine", "ts", *SCADA_FEATURES)


def scada_10min_sql(with_nulls: bool = False) -> str:
    a = "CASE WHEN min(event_id) % 17 <> 0 THEN {} END" if with_nulls else "{}"
    b = "CASE WHEN min(event_id) % 23 <> 0 THEN {} END" if with_nulls else "{}"
    return f"""
    SELECT 'Wk' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS filename, turbine, ts,
           active_power_kw, wind_speed_ms, hub_temp_c, temp_rotor_bearing_c, rotor_speed_rpm, blade_angle
    FROM (
      SELECT 'WT0' || CAST(user_id % 3 + 1 AS VARCHAR) AS turbine,
             time_bucket(INTERVAL 10 MINUTE, ts) AS ts,
             {a.format('avg(value) * sqrt(2.0)')} AS active_power_kw,
             {b.format("sqrt(avg(CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE)))")} AS wind_speed_ms,
             CAST(count(*) + 20 AS DOUBLE) AS hub_temp_c,
             sqrt(max(CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE))) * 2.0 + 25.0 AS temp_rotor_bearing_c,
             {a.format('min(value) * sqrt(2.0) / 10.0')} AS rotor_speed_rpm,
             CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS blade_angle
      FROM events GROUP BY 1, 2)
    """


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather feed (events by hour), with gaps in several columns."""
    ev = table(spark, sf_dir, "events")
    g = ev.select(F.window("ts", "1 hour").start.alias("ts"), "value", _k().alias("k"), "event_type",
                  "event_id", "user_id").groupBy("ts")
    hole = lambda m: F.min("event_id") % m == 0  # noqa: E731  (about 1 in m hours, at any scale factor)
    is_err = F.col("event_type") == "error"
    out = g.agg(
        F.when(~hole(19), F.sum(F.when(is_err, F.col("value")).otherwise(0.0)) / 100.0).alias("precip_intensity"),
        F.when(~hole(19), F.avg(F.when(is_err, 1.0).otherwise(0.0))).alias("precip_probability"),
        (F.avg("value") / 10.0).alias("temperature"),
        (F.min("value") / 10.0).alias("apparent_temperature"),
        (F.max("value") / 100.0).alias("dew_point"),
        (F.avg("k") / 100.0).alias("humidity"),
        F.when(~hole(13), F.avg("k") / 2.0 + 990.0).alias("pressure"),
        F.when(~hole(29), F.avg("k") / 10.0).alias("wind_speed"),
        F.when(~hole(11), F.max("k") / 8.0).alias("wind_gust"),
        F.when(~hole(31), F.avg(F.col("user_id") % 360)).alias("wind_bearing"),
        F.when(~hole(37), F.count(F.lit(1)) / 2.0).alias("visibility"),
    )
    return out.select(F.date_format("ts", "MMMyyyy").alias("month_label"), "ts", *WEATHER_FEATURES)


WEATHER_HOURLY_SQL = """
    SELECT strftime(ts, '%b%Y') AS month_label, ts, precip_intensity, precip_probability, temperature,
           apparent_temperature, dew_point, humidity, pressure, wind_speed, wind_gust, wind_bearing, visibility
    FROM (
      SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts,
        CASE WHEN min(event_id) % 19 <> 0
             THEN sum(CASE WHEN event_type = 'error' THEN value ELSE 0.0 END) / 100.0 END AS precip_intensity,
        CASE WHEN min(event_id) % 19 <> 0
             THEN avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS precip_probability,
        avg(value) / 10.0 AS temperature,
        min(value) / 10.0 AS apparent_temperature,
        max(value) / 100.0 AS dew_point,
        avg(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE)) / 100.0 AS humidity,
        CASE WHEN min(event_id) % 13 <> 0
             THEN avg(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE)) / 2.0 + 990.0 END AS pressure,
        CASE WHEN min(event_id) % 29 <> 0
             THEN avg(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE)) / 10.0 END AS wind_speed,
        CASE WHEN min(event_id) % 11 <> 0
             THEN max(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE)) / 8.0 END AS wind_gust,
        CASE WHEN min(event_id) % 31 <> 0 THEN avg(CAST(user_id % 360 AS DOUBLE)) END AS wind_bearing,
        CASE WHEN min(event_id) % 37 <> 0 THEN CAST(count(*) AS DOUBLE) / 2.0 END AS visibility
      FROM events GROUP BY 1)
"""


def daily_orders(spark: SparkSession, sf_dir: str, with_nulls: bool = True) -> DataFrame:
    """Daily series per order priority, several years (donor-year fills, long series)."""
    o = table(spark, sf_dir, "orders")
    hole = F.min("o_orderkey") % 17 == 0
    rev = F.sum("o_totalprice")
    avgp = F.avg("o_totalprice")
    out = o.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")).agg(
        (F.when(~hole, rev) if with_nulls else rev).alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        (F.when(~hole, avgp) if with_nulls else avgp).alias("avg_price"),
    )
    return out.select(F.date_format("ts", "MMMyyyy").alias("filename"), "series", "ts",
                      "revenue", "n_orders", "avg_price")


def daily_orders_sql(with_nulls: bool = True) -> str:
    h = "CASE WHEN min(o_orderkey) % 17 <> 0 THEN {} END" if with_nulls else "{}"
    return f"""
    SELECT strftime(ts, '%b%Y') AS filename, series, ts, revenue, n_orders, avg_price FROM (
      SELECT o_orderpriority AS series, o_orderdate AS ts,
             {h.format('sum(o_totalprice)')} AS revenue,
             CAST(count(*) AS DOUBLE) AS n_orders,
             {h.format('avg(o_totalprice)')} AS avg_price
      FROM orders GROUP BY 1, 2)
    """


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second daily feed (lineitem by ship date) with natural gaps, for the left join + year patch."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("ship_qty"), F.avg("l_discount").alias("ship_discount"))


DAILY_SHIPMENTS_SQL = """
    SELECT l_shipdate AS ts, sum(l_quantity) AS ship_qty, avg(l_discount) AS ship_discount
    FROM lineitem GROUP BY 1
"""


def farm_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily total series (all priorities): the long single series for lead/ACF/forecast."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"))


FARM_SERIES_SQL = """
    SELECT o_orderdate AS ts, sum(o_totalprice) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders,
           avg(o_totalprice) AS avg_price
    FROM orders GROUP BY 1
"""


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left feed with duplicate hours: one row per (hour, event type)."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.window("ts", "1 hour").start.alias("ts"), F.col("event_type").alias("filename")).agg(
        F.avg("value").alias("active_power_kw"), F.count(F.lit(1)).cast("double").alias("n_events"))


HOURLY_EVENTS_SQL = """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS filename,
           avg(value) AS active_power_kw, CAST(count(*) AS DOUBLE) AS n_events
    FROM events GROUP BY 1, 2
"""


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric feature table with a target (lineitem ⋈ part); key (l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        # lineitem keys repeat in the generated data, so rows get an id from all their columns and a number among equals
        F.xxhash64(*_LINE, F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINE))).alias("row_id"),
        "l_orderkey", "l_linenumber", "l_shipdate",
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"),
        F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice"),
        F.col("l_linenumber").cast("double").alias("l_linenumber_d"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net_price"),
    ).withColumnRenamed("l_linenumber_d", "line_no")


WIDE_FEATURES_SQL = """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax,
           CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(l_linenumber AS DOUBLE) AS line_no,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net_price
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""
WIDE_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "line_no"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the label missing on a fixed rule (kNN fill target)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                    F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("double")).alias("label"))


VECTORS_SQL = """
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features,
           CASE WHEN vec_id % 7 <> 0 THEN CAST(label AS DOUBLE) END AS label
    FROM embeddings
"""


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text with ``,`` thousands marks and bad cells (as in the SCADA export)."""
    li = table(spark, sf_dir, "lineitem")
    bad = F.col("l_linenumber") == 7
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(bad, F.lit("n/a")).otherwise(F.format_number("l_extendedprice", 2)).alias("l_extendedprice"),
        F.format_number("l_quantity", 1).alias("l_quantity"),
        F.concat(F.lit(" "), F.col("l_discount").cast("string"), F.lit(" ")).alias("l_discount"),
        "l_returnflag")
