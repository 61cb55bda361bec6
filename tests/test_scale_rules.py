"""No size switch drops or changes rows: NULL keys, NULL order values, ties, unlisted turbines, safe divisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gustlab.functions import columns as C
from gustlab.operators import evaluate as EV
from gustlab.operators import forecast as FC
from gustlab.operators import models as M
from gustlab.operators import stats as ST
from gustlab.operators import timeseries as tsx

BIG, SMALL = 10 ** 9, 10


@pytest.fixture(scope="module")
def messy(spark):
    """NULL series keys, NULL order values, and 90 % ties."""
    rows = []
    for i in range(300):
        key = None if i % 5 == 0 else "ab"[i % 2]
        order = None if i % 11 == 0 else (7.0 if i % 10 else float(i))
        rows.append((key, order, i))
    return spark.createDataFrame(rows, "g string, o double, i int").repartition(3)


def test_positions_are_the_same_small_and_large(messy):
    def numbered(n):
        out = tsx.sequence_index(messy, "o", ["g"], rows_per_bucket=n, tiebreak=["i"])
        return sorted((str(r["g"]), r["i"], r["_pos"]) for r in out.collect())

    small = numbered(SMALL)
    assert small == numbered(BIG) and len(small) == 300
    ungrouped = lambda n: sorted((r["i"], r["_pos"]) for r in tsx.sequence_index(
        messy, "o", rows_per_bucket=n, tiebreak=["i"]).collect())
    assert ungrouped(SMALL) == ungrouped(BIG)


def test_ties_are_divided(spark):
    df = spark.createDataFrame([(1.0,)] * 90 + [(2.0,)] * 10, "o double").repartition(4)
    ix, nb = tsx._positions(df, "o", rows_per_bucket=10, keep_bucket=True)
    sizes = [r["n"] for r in ix.groupBy("_bkt").agg(F.count("*").alias("n")).collect()]
    assert nb == 10 and max(sizes) < 60
    assert sorted(r["_pos"] for r in ix.collect()) == list(range(100))


def test_lead_lag_and_acf_keep_null_series(messy):
    def led(n):
        out = tsx.lead_value(messy.withColumn("k", F.col("i").cast("double")), "i", 2, "k", ["g"], out="v", rows_per_bucket=n)
        return sorted((str(r["g"]), r["i"], str(r["v"])) for r in out.collect())

    assert led(SMALL) == led(BIG)


def test_prefix_counts_keep_null_groups(messy):
    counts = messy.groupBy("g", F.col("i").cast("double").alias("v")).agg(F.count("*").alias("c"))
    got = lambda n: sorted((str(r["g"]), r["v"], r["__below"]) for r in ST._prefix_counts(counts, ["g"], "v", "c", n).collect())
    assert got(SMALL) == got(BIG) and len(got(BIG)) == 300


def test_quantiles_of_ties_and_null_groups(messy, monkeypatch):
    import numpy as np

    def run():
        return {(str(r["g"]), r["p"]): r["q"] for r in ST.exact_quantiles(messy, "o", [0.0, 0.1, 0.5, 0.95, 1.0], ["g"]).collect()}

    want = run()
    monkeypatch.setattr(ST, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(ST._prefix_counts, "__defaults__", (3,))
    assert run() == want
    vals = [r["o"] for r in messy.where("g is null and o is not null").collect()]
    assert want[("None", 0.95)] == pytest.approx(np.quantile(vals, 0.95))


def test_unlisted_turbines_take_no_part(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", t, 1.0), ("b", t, 9.0)], "turbine string, ts timestamp_ntz, p double")
    for pivot in (True, False):
        assert tsx.hourly_farm(df, ["p"], turbines=["a"], pivot=pivot).first()["p"] == 1.0


def test_constant_columns_have_no_correlation(spark):
    for width in (2, 30):
        cols = [f"c{i}" for i in range(width)]
        df = spark.createDataFrame([tuple([1.0] + [float((r * (i + 2)) % 7) for i in range(width - 1)]) for r in range(20)],
                                   ", ".join(f"{c} double" for c in cols))
        got = {(r["x"], r["y"]): r["r"] for r in ST.correlation_matrix(df, cols).collect()}
        assert got[("c0", "c1")] is None
        assert width == 2 or got[("c1", "c2")] is not None


def test_a_constant_column_correlates_with_nothing(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), 7.0, 2.0 * i + i % 3) for i in range(40)], "t double, a double, c double, b double")
    got = {r["y_var"]: r for r in ST.correlate(df, "t", ["a", "b", "c"]).collect()}
    assert got["c"]["n"] == 40 and got["c"]["cor_coef"] is None and got["c"]["pearson_r"] is None
    assert got["b"]["cor_coef"] > 0.99 and got["a"]["pearson_r"] is not None
    assert [r["y_var"] for r in ST.correlation_test(df, "t", ["b", "c"], 0.0).collect()] == ["b"]
    assert ST.correlation_test(df, "c", ["a", "b"], 0.0).count() == 0


def test_scaling_keeps_rows_of_constant_inputs_for_models(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "x double, c double")
    got = tsx.zscore(df, ["x", "c"], centre_constant=True).collect()
    assert [r["c"] for r in got] == [0.0, 0.0, None] and got[0]["x"] == -got[1]["x"] and got[2]["x"] is None


def test_forecasts_learn_beside_a_constant_input(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=h), 50.0 + 10 * ((h * 7) % 24) / 24, float((h * 5) % 11), 145.0) for h in range(240)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, p double, w double, c double")
    with_c = FC.lagged_forecast(df, "p", ["w", "c"], "2024-01-09 00:00:00", max_iter=3)
    without = FC.lagged_forecast(df, "p", ["w"], "2024-01-09 00:00:00", max_iter=3)
    assert with_c.count() == without.count() > 20
    grid = FC.backtest_grid(df, "p", ["w", "c"], [1, 2], ["2024-01-09 00:00:00"], units=8).collect()
    assert len(grid) == 2 and all(r["n"] > 20 for r in grid)


def test_rank_columns_keeps_repeated_keys(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 4.0), (2, 3.0, 4.0)], "k int, a double, b double")
    got = sorted(tuple(r) for r in ST.rank_columns(df, ["a", "b"], ["k"]).collect())
    assert got == [(1, 1.0, 3.0), (1, 2.0, 1.5), (2, 3.0, 1.5)]


def test_scoring_keeps_rows_with_null_inputs(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(2 * i)) for i in range(40)] + [(None, 1.0, 3.0)], "a double, b double, y double")
    fm = M.fit_random_forest(df, ["a", "b"], "y", num_trees=3)
    out = fm.predict(df)
    assert out.count() == 41 and out.where("a is null").first()["prediction"] is None
    assert EV.regression_metrics(out, "y", "prediction").first()["n"] == 40


def test_metrics_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0)], "y double, p double")
    r = EV.regression_metrics(df, "y", "p").first()
    assert r["r2_corr"] is None and r["mean_error_pct"] is None and r["mae"] == 2.0
    z = tsx.zscore(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"])
    assert [x["x"] for x in z.collect()] == [None, None]
    a = tsx.acf(spark.createDataFrame([(i, 5.0) for i in range(6)], "ts int, x double"), "x", 2).collect()
    assert all(x["acf"] is None for x in a)


def test_timestamps_do_not_pass_through_a_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        texts = ["26/03/2017 01:30", "26/03/2017 02:30", " 29/02/2016 23:59 ", "29/02/2017 00:00", "31/04/2017 00:00",
                 "01/13/2017 00:00", "01/01/2017 24:00", "x", "", None, "1/1/2017 1:00"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r["v"] for r in df.select("i", C.parse_dmy_hm(F.col("t")).cast("string").alias("v")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2017-03-26 01:30:00", "2017-03-26 02:30:00", "2016-02-29 23:59:00"] + [None] * 8


def test_degrees_without_minutes(spark):
    df = spark.createDataFrame([("51",), ("-2 30",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(C.dms_to_decimal(F.col("t"))).collect()] == [51.0, -2.5, None, None]
