"""Joins and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustlab.functions.columns import qcol


def join_weather(scada_hourly: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    """Left equi-join of the hourly farm table with weather on the hour.

    No hint: AQE picks broadcast or sort-merge from measured sizes.
    """
    return scada_hourly.join(weather, on=ts, how="left")


def dedupe_keep_max(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """One row per key, the one with the largest ``by``.

    ``max(struct(by, rest...))`` is an aggregate with map-side partial merge, so a key holding a large share
    of the rows is reduced before the shuffle; ties on ``by`` resolve by the remaining columns.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != by]
    g = df.groupBy(*keys).agg(F.max(F.struct(qcol(by).alias(by), *[qcol(c) for c in rest])).alias("__r"))
    return g.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [by, *rest]])


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order`` (E7). Spark keeps no file order, so the order is explicit;
    remaining columns break ties."""
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    g = df.groupBy(*keys).agg(F.min(F.struct(*[qcol(c) for c in order + rest])).alias("__r"))
    return g.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in order + rest])


def curve_segments(curve: DataFrame, x: str = "wind_speed", y: str = "power") -> DataFrame:
    """Consecutive curve points as segments ``[x0, x1)`` with their end values; the last point closes."""
    w = Window.orderBy(x)  # the curve is a fixed 43-point table
    seg = curve.select(F.col(x).alias("x0"), F.col(y).alias("y0"),
                       F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    return seg.withColumn("x1c", F.coalesce("x1", "x0")).withColumn("y1", F.coalesce("y1", "y0"))


def expected_power(df: DataFrame, curve: DataFrame, wind: str = "wind_speed_ms", power: str = "active_power_kw",
                   band: float = 0.2) -> DataFrame:
    """Nominal power at each row's wind speed by linear interpolation on the curve, deviation and ±band flag.

    Range join as an equi-join: segments are spread over the integer buckets they cover and joined on
    ``floor(wind)``, then filtered to ``x0 <= wind < x1`` (the last point matches exactly). Spark broadcasts
    the curve while it is under its size limit. Outside the curve the expected power is NULL.
    """
    seg = curve_segments(curve)
    seg = seg.withColumn("__b", F.explode(F.sequence(F.floor("x0").cast("long"), F.floor("x1c").cast("long"))))
    seg = seg.select(F.col("__b").alias("__sb"), "x0", "y0", "x1", "y1")
    r = df.withColumn("__w", qcol(wind).cast("double"))
    hit = ((F.col("__w") >= F.col("x0")) & (F.col("__w") < F.col("x1"))) | (
        F.col("x1").isNull() & (F.col("__w") == F.col("x0")))
    # Segments are disjoint, so each row meets at most one: a single broadcast hash join, no regrouping.
    j = r.join(seg, (F.floor(F.col("__w")).cast("long") == F.col("__sb")) & hit, "left")
    frac = F.when(F.col("x1") > F.col("x0"), (F.col("__w") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    g = j.withColumn("expected_power", F.col("y0") + frac * (F.coalesce("y1", "y0") - F.col("y0"))).drop(
        "__w", "__sb", "x0", "y0", "x1", "y1")
    e = F.col("expected_power")
    return g.withColumns({
        "power_deviation": qcol(power) - e,
        "in_band": (qcol(power) >= e * (1 - band)) & (qcol(power) <= e * (1 + band)),
    })
