"""Physical-plan shapes the design relies on (checked with explain output, AQE off for the static shape)."""

import datetime as dt

import re

import pytest

from gustlab.operators import joins as J
from gustlab.operators import timeseries as tsx
from gustlab.sources import files as SRC


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def static(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_hourly_farm_pivot_plan_has_one_exchange(static, tmp_path):
    t0 = dt.datetime(2020, 1, 1)
    rows = [(f"WT0{i % 3 + 1}", t0 + dt.timedelta(minutes=10 * j), float(j)) for i in range(3) for j in range(50)]
    static.createDataFrame(rows, "turbine string, ts timestamp_ntz, p double").write.parquet(str(tmp_path / "s"))
    src = static.read.parquet(str(tmp_path / "s"))
    one = _plan(tsx.hourly_farm(src, ["p"], turbines=["WT01", "WT02", "WT03"]))
    two = _plan(tsx.hourly_farm(src, ["p"]))
    assert one.count("Exchange hashpartitioning") == 1
    assert two.count("Exchange hashpartitioning") == 2
    assert "PartialMerge" in one or "partial_" in one  # map-side partial aggregation before the shuffle


def test_curve_join_is_an_equi_join(static):
    df = static.createDataFrame([(5.2, 300.0)], "wind_speed_ms double, active_power_kw double")
    plan = _plan(J.expected_power(df, SRC.power_curve(static)))
    assert re.search("BroadcastHashJoin|SortMergeJoin", plan) and "BroadcastNestedLoopJoin" not in plan


def test_dedupe_is_an_aggregate_not_a_window(static):
    t0 = dt.datetime(2020, 1, 1)
    df = static.createDataFrame([(t0, "a", 1.0), (t0, "b", 2.0)], "ts timestamp_ntz, f string, p double")
    plan = _plan(J.dedupe_keep_max(df, ["ts"], "p"))
    assert "Window" not in plan and ("SortAggregate" in plan or "HashAggregate" in plan or "ObjectHashAggregate" in plan)
