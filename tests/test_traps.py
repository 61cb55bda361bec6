"""Hand-computed answers for the semantic traps of SURVEY §1 (T1-T20) and the operators behind them."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gustlab.functions import columns as C
from gustlab.operators import evaluate as ev
from gustlab.operators import impute as I
from gustlab.operators import quality as Q
from gustlab.operators import reshape as R
from gustlab.operators import stats as ST
from gustlab.operators import timeseries as tsx
from gustlab.sources import files as SRC

T0 = dt.datetime(2018, 7, 1, 0, 0)


def ts(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_t1_trailer_modes(spark, tmp_path):
    d = tmp_path / "exports"
    d.mkdir()
    body = "timestamp;a1;a2\n01/07/2018 00:00;1,234.5;2\n01/07/2018 00:10;3;4\nmeta line;x;y\nmore meta;;\n"
    (d / "Turbine_Data_Site07-2018.csv").write_text(body)
    by_ts = SRC.read_scada(spark, str(d))
    assert by_ts.count() == 2
    assert by_ts.select("filename").first()[0] == "Jul2018"
    exact = SRC.read_scada(spark, str(d / "*.csv"), trailer_rows=2)
    assert sorted(r["a2"] for r in exact.collect()) == ["2", "4"]
    # Thousands mark removed
    assert R.cast_numeric(by_ts.select("a1")).agg(F.max("a1")).first()[0] == 1234.5


def test_t3_donor_row_vs_cell(spark):
    df = spark.createDataFrame([("f", "WT01", ts(0), None, 5.0), ("f", "WT01", ts(10), 1.0, 2.0)],
                               "filename string, turbine string, ts timestamp_ntz, a double, b double")
    donor = spark.createDataFrame([("d", "WT01", ts(0) - dt.timedelta(days=365), 7.0, 8.0)],
                                  "filename string, turbine string, ts timestamp_ntz, a double, b double")
    row = {r["ts"]: (r["a"], r["b"]) for r in I.impute_from_donor(df, donor, ["turbine"], ["a", "b"], mode="row").collect()}
    cell = {r["ts"]: (r["a"], r["b"]) for r in I.impute_from_donor(df, donor, ["turbine"], ["a", "b"], mode="cell").collect()}
    assert row[ts(0)] == (7.0, 8.0)
    assert cell[ts(0)] == (7.0, 5.0)
    assert row[ts(10)] == (1.0, 2.0)
    tags = {r["filename"] for r in I.impute_from_donor(df, donor, ["turbine"], ["a", "b"]).collect()}
    assert tags == {"f_imputed"}


def test_donor_fill_never_adds_rows(spark):
    df = spark.createDataFrame([("f", "WT01", ts(0), None)], "filename string, turbine string, ts timestamp_ntz, a double")
    donor = spark.createDataFrame([("d", "WT01", ts(0) - dt.timedelta(days=365), 1.0),
                                   ("d", "WT01", ts(0) - dt.timedelta(days=365), 2.0)],
                                  "filename string, turbine string, ts timestamp_ntz, a double")
    out = I.impute_from_donor(df, donor, ["turbine"], ["a"]).collect()
    assert len(out) == 1 and out[0]["a"] == 1.0


def test_t4_zero_variance_union_and_all(spark):
    df = spark.createDataFrame([("m1", "A", 1.0, 5.0), ("m1", "A", 1.0, 6.0), ("m2", "A", 2.0, 7.0), ("m2", "A", 3.0, 7.0)],
                               "m string, t string, x double, y double")
    anyv = {r[0] for r in Q.zero_variance(df, ["x", "y"], by=["m", "t"]).collect()}
    allv = {r[0] for r in Q.zero_variance(df, ["x", "y"], by=["m", "t"], scope="all").collect()}
    assert anyv == {"x", "y"} and allv == set()


def test_t6_farm_value_is_max_over_turbine_means(spark):
    rows = [("WT01", ts(0), 1.0), ("WT01", ts(10), 3.0), ("WT02", ts(0), 10.0), ("WT02", ts(50), 0.0)]
    df = spark.createDataFrame(rows, "turbine string, ts timestamp_ntz, p double")
    for turbines in (None, ["WT01", "WT02"]):
        r = tsx.hourly_farm(df, ["p"], turbines=turbines).first()
        assert r["p"] == 5.0 and r["ts"] == T0
        m = tsx.hourly_farm(df, ["p"], turbines=turbines, farm_agg="mean").first()
        assert m["p"] == 3.5


def test_t18_nan_is_missing(spark):
    df = spark.createDataFrame([("WT01", ts(0), float("nan")), ("WT01", ts(10), 4.0)],
                               "turbine string, ts timestamp_ntz, p double")
    assert tsx.hourly_farm(df, ["p"]).first()["p"] == 4.0


def test_t19_half_even(spark):
    df = spark.createDataFrame([(0.0625,), (2.5,), (0.125,)], "x double")
    got = [r[0] for r in df.select(C.round_half_even(F.col("x"), 3)).collect()]
    assert got == [0.062, 2.5, 0.125]
    assert df.select(C.round_half_even(F.col("x"), 0)).collect()[1][0] == 2.0


def test_t10_lead_wraps_to_first(spark):
    df = spark.createDataFrame([(ts(60 * i), float(i)) for i in range(4)], "ts timestamp_ntz, x double")
    for method in ("index", "window"):
        got = {r["ts"]: r["x_lead1"] for r in tsx.lead_value(df, "x", 1, wrap=True, method=method).collect()}
        assert got[ts(180)] == 0.0 and got[ts(0)] == 1.0
        plain = {r["ts"]: r["x_lead1"] for r in tsx.lead_value(df, "x", 1, method=method).collect()}
        assert plain[ts(180)] is None


def test_t12_reference_restoration_scores_zero_model_perfectly(spark):
    df = spark.createDataFrame([(ts(60 * i), float(v)) for i, v in enumerate([5, 7, 4, 9, 6])], "ts timestamp_ntz, p double")
    d = tsx.difference(df, "p", 1, lead_col="lead", diff_col="diff").withColumn("pred", F.lit(0.0))
    ref = ev.regression_metrics(tsx.undifference(d, "pred", "p", "lead", mode="reference"), "p", "predicted_power").first()
    cau = ev.regression_metrics(tsx.undifference(d, "pred", "p", "lead", mode="causal"), "p", "predicted_power").first()
    assert ref["rmse"] == 0.0
    assert cau["mae"] == pytest.approx((2 + 3 + 5 + 3) / 4)


def test_undifference_inverts_difference(spark):
    df = spark.createDataFrame([(ts(60 * i), float(v)) for i, v in enumerate([5, 7, 4, 9, 6, 1])], "ts timestamp_ntz, p double")
    d = tsx.difference(df, "p", 1, lead_col="lead", diff_col="diff", wrap=False)
    # a perfect difference forecast restores the exact next value
    out = tsx.undifference(d.filter(F.col("diff").isNotNull()), "diff", "p", "lead", mode="causal")
    for r in out.collect():
        assert r["predicted_power"] == r["p"]


def test_t14_split_boundaries(spark):
    start = dt.datetime(2018, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(hours=h),) for h in range(-24 * 9, 72)], "ts timestamp_ntz")
    lab = {r["ts"]: r["split"] for r in tsx.temporal_split(df, "2018-01-02 00:00:00", 7, 1, 1, 1).collect()}
    t = dt.datetime(2018, 1, 1, 23)
    assert lab[t] == "test"
    assert lab[t - dt.timedelta(hours=1)] == "validation"
    assert lab[t - dt.timedelta(days=1) + dt.timedelta(hours=1)] == "validation"
    assert lab[t - dt.timedelta(days=1)] == "train"
    assert lab[t - dt.timedelta(days=7)] == "train"
    assert lab[t - dt.timedelta(days=7, hours=1)] is None
    assert lab[t + dt.timedelta(days=1, hours=1)] == "test"
    assert lab[t + dt.timedelta(days=1, hours=2)] is None


def test_t15_t16_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "a double, p double")
    m = ev.regression_metrics(df, "a", "p").first()
    assert m["n_zero"] == 1
    assert m["mape"] == pytest.approx(12.5)
    assert m["mae"] == pytest.approx(2 / 3)
    sst = sum((v - 2.0) ** 2 for v in (0, 2, 4))
    assert m["r2"] == pytest.approx(1 - 2.0 / (sst + 1e-7))
    assert m["r2_corr"] == pytest.approx(1.0)


def test_t7_spearman_coefficient_pearson_p(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    ys = [1.0, 4.0, 9.0, 16.0, 25.0, 36.0, 49.0, 1000.0]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    r = ST.correlation_test(df, "x", ["y"], min_abs=0.0, max_p=1.1).first()
    assert r["cor_coef"] == pytest.approx(1.0)
    assert r["pearson_r"] < 0.8
    from gustlab.functions.stats_math import cor_test_p
    assert r["p_val"] == pytest.approx(float(cor_test_p(r["pearson_r"], 8)))


def test_t8_any_of_patterns(spark):
    df = spark.createDataFrame([("Mar2017",), ("Jul2018",), ("Jan2017",)], "f string")
    assert df.filter(R.any_of(F.col("f"), ["Mar", "Jul"])).count() == 2


def test_t17_weather_month_label_kept_apart(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    (d / "01-2017.csv").write_text('"","time","pressure","precipType"\n"1","2017-01-01 00:00:00",1000,"rain"\n')
    (d / "02-2017.csv").write_text('"","time","humidity"\n"1","2017-02-01 00:00:00",0.5\n')
    w = SRC.read_weather(spark, str(d / "*.csv"), drop_pattern="precipt")
    rows = {r["month_label"]: r for r in w.collect()}
    assert set(rows) == {"Jan2017", "Feb2017"}
    assert rows["Feb2017"]["pressure"] is None and rows["Jan2017"]["humidity"] is None
    assert "precipType" not in w.columns


def test_t20_patch_from_year(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 3, 26, 1), None), (dt.datetime(2018, 3, 26, 1), 3.0),
                                (dt.datetime(2018, 3, 25, 1), None), (dt.datetime(2017, 3, 25, 1), 9.0),
                                (dt.datetime(2018, 1, 1, 0), None)], "ts timestamp_ntz, w double")
    got = {r["ts"]: r["w"] for r in I.patch_from_year(df, ["w"]).collect()}
    assert got[dt.datetime(2017, 3, 26, 1)] == 3.0
    assert got[dt.datetime(2018, 3, 25, 1)] == 9.0
    assert dt.datetime(2018, 1, 1, 0) not in got


def test_b19_year_shift_month_safe(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 2, 29),)], "ts timestamp_ntz")
    assert df.select(C.add_years(F.col("ts"), 1)).first()[0] == dt.datetime(2017, 2, 28)


def test_a5_month_label(spark):
    df = spark.createDataFrame([("01-2017",), ("12-2018",)], "s string")
    assert [r[0] for r in df.select(C.month_label(F.col("s"))).collect()] == ["Jan2017", "Dec2018"]


def test_b21_dms(spark):
    df = spark.createDataFrame([("53 20 30",), ("-6 15 0",)], "s string")
    got = [r[0] for r in df.select(C.dms_to_decimal(F.col("s"))).collect()]
    assert got[0] == pytest.approx(53 + 20 / 60 + 30 / 3600) and got[1] == pytest.approx(-6.25)


def test_b1_turbines_to_long(spark):
    wide = spark.createDataFrame([("t0", "1", "2", "3", "4")], "ts string, a1 string, b1 string, a2 string, b2 string")
    long = R.turbines_to_long(wide, "ts", ["a", "b"]).collect()
    assert [(r["turbine"], r["a"], r["b"]) for r in long] == [("WT01", "1", "2"), ("WT02", "3", "4")]


def test_c7_expected_power_interpolates(spark):
    df = spark.createDataFrame([(4.25, 100.0), (25.0, 3400.0), (3.0, 0.0), (30.0, 0.0)], "wind_speed_ms double, active_power_kw double")
    got = {r["wind_speed_ms"]: r for r in __import__("gustlab.operators.joins", fromlist=["x"]).expected_power(
        df, SRC.power_curve(spark)).collect()}
    assert got[4.25]["expected_power"] == pytest.approx((75 + 170) / 2)
    assert got[4.25]["in_band"] is False or got[4.25]["in_band"] == (100 >= 0.8 * 122.5 and 100 <= 1.2 * 122.5)
    assert got[25.0]["expected_power"] == 3400.0
    assert got[3.0]["expected_power"] is None and got[30.0]["expected_power"] is None
    assert len(got) == 4


def test_e6_e7_dedupe(spark):
    df = spark.createDataFrame([(T0, "b", 5.0), (T0, "a", 7.0), (ts(60), "c", 1.0)], "ts timestamp_ntz, f string, p double")
    from gustlab.operators import joins as J
    mx = {r["ts"]: r["f"] for r in J.dedupe_keep_max(df, ["ts"], "p").collect()}
    first = {r["ts"]: r["f"] for r in J.dedupe_keep_first(df, ["ts"], ["f"]).collect()}
    assert mx[T0] == "a" and first[T0] == "a" and mx[ts(60)] == "c"


def test_missing_percent_and_rows(spark):
    df = spark.createDataFrame([("m", "WT01", None, 1.0), ("m", "WT02", 2.0, None), ("m", "WT02", None, 1.0),
                                ("m", "WT01", 3.0, 1.0)], "month string, turbine string, p double, w double")
    pct = {r["feature"]: r["pct_missing"] for r in Q.missing_percent(df, ["p", "w"], by=["month"]).collect()}
    assert pct == {"p": 50.0, "w": 25.0}
    mr = Q.missing_rows(df, "p", turbines=["WT01", "WT02"]).first()
    assert (mr["WT01"], mr["WT02"]) == (1, 1)
    assert Q.duplicate_keys(df, ["turbine"]).first()["n_duplicated_keys"] == 2


def test_math_functions():
    from gustlab.functions.stats_math import chi2_sf, cor_test_p

    assert float(cor_test_p(0.5, 20)) == pytest.approx(0.02476956, rel=1e-6)
    assert float(chi2_sf(3.841458820694124, 1)) == pytest.approx(0.05, rel=1e-9)
    assert float(chi2_sf(10.0, 10)) == pytest.approx(0.4404932850652124, rel=1e-9)
    assert math.isnan(float(cor_test_p(0.3, 2)))


def test_t1_exact_trailer_across_splits(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    body = ["timestamp;v"] + [f"01/07/2018 {h:02d}:{m:02d};{h * 60 + m}" for h in range(24) for m in range(0, 60, 10)]
    body += ["trailer a;x", "trailer b;y", "01/07/2018 23:59;999"]  # the last line even parses as a timestamp
    (d / "Site_Data_Export07-2018.csv").write_text("\n".join(body) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = SRC.read_scada(spark, str(d / "*.csv"), trailer_rows=3)
        vals = sorted(int(r["v"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert vals == [h * 60 + m for h in range(24) for m in range(0, 60, 10)]


def test_t2_missing_percent_only_named_columns(spark):
    df = spark.createDataFrame([("m", T0, None, 1.0), ("m", None, 2.0, 1.0)], "month string, ts timestamp_ntz, a double, b double")
    feats = {r["feature"] for r in Q.missing_percent(df, ["a", "b"], by=["month"]).collect()}
    assert feats == {"a", "b"}  # keys and the timestamp are left out explicitly


def test_t5_all_features_rounded(spark):
    rows = [("WT01", ts(0), 1.23456, 7.65432), ("WT01", ts(10), 1.0, 7.0)]
    df = spark.createDataFrame(rows, "turbine string, ts timestamp_ntz, a double, b double")
    r = tsx.hourly_farm(df, ["a", "b"]).first()
    assert (r["a"], r["b"]) == (1.117, 7.327)


def test_t11_order_by_time_not_arrival(spark):
    # rows appended out of time order (as patched rows are) still lead in time order
    df = spark.createDataFrame([(ts(120), 3.0), (ts(0), 1.0), (ts(60), 2.0)], "ts timestamp_ntz, x double")
    got = {r["ts"]: r["x_lead1"] for r in tsx.lead_value(df, "x", 1).collect()}
    assert got[ts(0)] == 2.0 and got[ts(60)] == 3.0 and got[ts(120)] is None


def test_t13_scaler_fit_on_train_only(spark):
    df = spark.createDataFrame([(0.0, "train"), (2.0, "train"), (100.0, "test")], "x double, split string")
    all_rows = tsx.zscore_fit(df, ["x"])["x"]
    train = tsx.zscore_fit(df, ["x"], F.col("split") == "train")["x"]
    assert train == (1.0, pytest.approx(math.sqrt(2.0)))
    assert all_rows[0] == pytest.approx(34.0)
    scaled = {r["split"]: r["x"] for r in tsx.zscore(df.filter("split = 'test'"), ["x"], stats={"x": train}).collect()}
    assert scaled["test"] == pytest.approx(99.0 / math.sqrt(2.0))
