"""Distributed paths agree with the simple ones, and structural invariants hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gustlab.operators import impute as I
from gustlab.operators import models as M
from gustlab.operators import stats as ST
from gustlab.operators import timeseries as tsx

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(s, T0 + dt.timedelta(hours=i), float(rng.integers(0, 20))) for s in ("a", "b") for i in range(500)]
    return spark.createDataFrame(rows, "sid string, ts timestamp_ntz, x double")


def test_sequence_index_bucketed_equals_window(spark, series):
    small = tsx.sequence_index(series, "ts", ["sid"], rows_per_bucket=37)
    w = Window.partitionBy("sid").orderBy("ts")
    ref = series.withColumn("r", F.row_number().over(w) - 1)
    j = small.join(ref, ["sid", "ts"])
    assert j.filter(F.col("_pos") != F.col("r")).count() == 0
    assert j.count() == 1000


def test_average_rank_bucketed_equals_sql(spark, series):
    t1 = ST._prefix_counts(series.groupBy("sid", "x").agg(F.count(F.lit(1)).alias("c")), ["sid"], "x", "c",
                           rows_per_bucket=5)
    t2 = ST._prefix_counts(series.groupBy("sid", "x").agg(F.count(F.lit(1)).alias("c")), ["sid"], "x", "c")
    a = {(r["sid"], r["x"]): r["__below"] for r in t1.collect()}
    b = {(r["sid"], r["x"]): r["__below"] for r in t2.collect()}
    assert a == b
    ranks = ST.average_rank_table(series, "x", ["sid"]).collect()
    pdf = series.toPandas()
    for r in ranks[:20]:
        g = pdf[pdf.sid == r["sid"]]["x"].rank(method="average")
        assert r["rank"] == pytest.approx(g[pdf[pdf.sid == r["sid"]]["x"] == r["x"]].iloc[0])


def test_exact_median_and_quantiles(spark, series):
    med = {r["__var"]: r["median"] for r in I.median_values(series, ["x"]).collect()}
    assert med["x"] == pytest.approx(float(np.median(series.toPandas()["x"])))
    qs = {r["p"]: r["q"] for r in ST.exact_quantiles(series, "x", [0.1, 0.5, 0.9]).collect()}
    vals = series.toPandas()["x"].to_numpy()
    for p, q in qs.items():
        assert q == pytest.approx(float(np.quantile(vals, p)))


def test_lead_index_and_window_agree(spark, series):
    a = tsx.lead_value(series, "x", 3, by=["sid"], wrap=True, rows_per_bucket=50)
    b = tsx.lead_value(series, "x", 3, by=["sid"], wrap=True, method="window")
    j = a.join(b.withColumnRenamed("x_lead3", "y"), ["sid", "ts", "x"])
    assert j.filter(~F.col("x_lead3").eqNullSafe(F.col("y"))).count() == 0


def test_acf_lag0_is_one_and_matches_numpy(spark, series):
    a = {r["lag"]: r["acf"] for r in tsx.acf(series.filter("sid = 'a'"), "x", 5).collect()}
    x = series.filter("sid = 'a'").orderBy("ts").toPandas()["x"].to_numpy()
    d = x - x.mean()
    assert a[0] == pytest.approx(1.0)
    assert a[3] == pytest.approx(float((d[:-3] * d[3:]).sum() / (d * d).sum()))


def test_decile_buckets_sum_to_n(spark, series):
    dc = ST.decile_calibration(series.withColumn("p", F.col("x") + F.rand(1)), "x", "p").collect()
    assert sum(r["n"] for r in dc) == 1000 and {r["bucket"] for r in dc} <= set(range(1, 11))


def test_split_parts_disjoint_and_complete(spark, series):
    s = M.stratified_split(series, "x", keys=["sid", "ts"]).cache()
    assert s.count() == 1000
    assert s.select("sid", "ts").distinct().count() == 1000
    tr = s.filter("split = 'train'").count()
    assert 690 <= tr <= 710


def test_knn_chunks_equal_single_chunk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)], float(i % 3) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y double")
    a = I.impute_by_knn(df, "id", "f", "y", k=3, pivots=12, block=10).collect()
    b = I.impute_by_knn(df, "id", "f", "y", k=3).collect()
    c = I.impute_by_knn(df.repartition(6), "id", "f", "y", k=3, pivots=1, block=20).collect()
    assert {r["id"]: r["y"] for r in a} == {r["id"]: r["y"] for r in b} == {r["id"]: r["y"] for r in c}
    # brute force check of one query row
    pdf = df.toPandas()
    q = pdf[pdf.y.isna()].iloc[0]
    tr = pdf[pdf.y.notna()]
    d = tr.f.apply(lambda v: float(np.sum((np.array(v) - np.array(q.f)) ** 2)))
    exp = tr.assign(d=d).sort_values(["d", "id"]).head(3).y.mean()
    assert {r["id"]: r["y"] for r in a}[q.id] == pytest.approx(round(exp, 2))


def test_sequence_windows_content(spark, series):
    s = tsx.sequence_windows(series.filter("sid = 'a'"), ["x"], 3)
    x = series.filter("sid = 'a'").orderBy("ts").toPandas()["x"].tolist()
    got = {r["ts"]: r["seq"] for r in s.collect()}
    assert [v[0] for v in got[T0 + dt.timedelta(hours=5)]] == x[3:6]
    assert len(got[T0]) == 1


def test_knn_cv_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3)], float(rng.integers(0, 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y double")
    cv = {(r["k"], r["fold"]): r["rmse"] for r in I.knn_cv(df, "id", "f", "y", ks=(3, 5), folds=4, repeats=1,
                                                            pivots=5, block=20).collect()}
    folds = {r["id"]: r["fold"] for r in M.kfold(df, ["id"], folds=4, seed=123).collect()}
    pdf = df.toPandas()
    X = np.stack(pdf.f.to_numpy())
    for k in (3, 5):
        for f in range(4):
            errs = []
            for i, row in pdf.iterrows():
                if folds[row.id] != f:
                    continue
                others = pdf[[folds[j] != f for j in pdf.id]]
                d = ((np.stack(others.f.to_numpy()) - X[i]) ** 2).sum(axis=1)
                nn = others.assign(d=d).sort_values(["d", "id"]).head(k)
                errs.append(nn.y.mean() - row.y)
            assert cv[(k, f)] == pytest.approx(float(np.sqrt(np.mean(np.square(errs)))))


def test_wide_paths_agree(spark):
    rng = np.random.default_rng(9)
    cols = [f"c{i}" for i in range(6)]
    rows = [tuple(float(v) for v in rng.normal(size=6)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    a = {(r["x"], r["y"]): r["r"] for r in ST.correlation_matrix(df, cols).collect()}
    b = np.corrcoef(np.array(rows).T)
    assert len(a) == 15 and all(a[(f"c{i}", f"c{j}")] == pytest.approx(b[i, j], abs=1e-12) for i in range(6) for j in range(i + 1, 6))
    t0 = dt.datetime(2020, 1, 1)
    farm = spark.createDataFrame([(f"WT{i % 4}", t0 + dt.timedelta(minutes=10 * j), float(i * j % 7))
                                  for i in range(4) for j in range(30)], "turbine string, ts timestamp_ntz, p double")
    one = {r["ts"]: r["p"] for r in tsx.hourly_farm(farm, ["p"], turbines=["WT0", "WT1", "WT2", "WT3"]).collect()}
    two = {r["ts"]: r["p"] for r in tsx.hourly_farm(farm, ["p"], turbines=["WT0", "WT1", "WT2", "WT3"],
                                                    pivot=False).collect()}
    assert one == two


def test_acf_bucketed_edges_match_numpy(spark, series, monkeypatch):
    x = series.filter("sid = 'a'").orderBy("ts").toPandas()["x"].to_numpy()
    d = x - x.mean()
    orig = tsx.sequence_index

    def small_buckets(*a, **k):
        k["rows_per_bucket"] = 37
        return orig(*a, **k)

    monkeypatch.setattr(tsx, "sequence_index", small_buckets)
    got = {r["lag"]: r["acf"] for r in tsx.acf(series.filter("sid = 'a'"), "x", 12).collect()}
    for h in range(13):
        assert got[h] == pytest.approx(float((d[: len(d) - h] * d[h:]).sum() / (d * d).sum()), abs=1e-12)


def test_lag_and_lead_across_bucket_edges(spark, series):
    for k in (1, 4, -2, -5):
        a = tsx.lead_value(series, "x", k, by=["sid"], out="v", rows_per_bucket=23)
        b = tsx.lead_value(series, "x", k, by=["sid"], out="w", method="window")
        j = a.join(b.drop("x"), ["sid", "ts"])
        assert j.count() == 1000
        assert j.filter(~F.col("v").eqNullSafe(F.col("w"))).count() == 0


def test_sequence_windows_window_equals_fanout(spark, series, monkeypatch):
    orig = tsx._positions

    def small(df, order, by=(), idx=tsx.IDX, rows_per_bucket=None, *rest, **k):
        k.pop("rows_per_bucket", None)
        return orig(df, order, by, idx, 29, *rest, **k)

    monkeypatch.setattr(tsx, "_positions", small)
    a = {(r["sid"], r["ts"]): r["seq"] for r in tsx.sequence_windows(series, ["x"], 4, by=["sid"]).collect()}
    b = {(r["sid"], r["ts"]): r["seq"] for r in tsx.sequence_windows(series, ["x"], 4, by=["sid"], method="fanout").collect()}
    assert a.keys() == b.keys() and all(a[k] == b[k] for k in a)


def test_positioned_lags_across_edges(spark, series):
    ix, nb = tsx._positions(series, "ts", ["sid"], rows_per_bucket=31, keep_bucket=True)
    assert nb > 1
    got = tsx.positioned_lags(ix, nb, ["sid"], "x", [1, 2, 5], "l")
    w = Window.partitionBy("sid").orderBy("ts")
    ref = series.select("sid", "ts", *[F.lag("x", k).over(w).alias(f"r{k}") for k in (1, 2, 5)])
    j = got.join(ref, ["sid", "ts"])
    assert j.count() == 1000
    for k in (1, 2, 5):
        assert j.filter(~F.col(f"l{k}").eqNullSafe(F.col(f"r{k}"))).count() == 0


def test_queries_that_ask_every_cell_leave_in_small_steps():
    import pandas as pd

    i, c = np.nonzero(np.ones((50, 30), bool))
    got = list(I._asking(pd.DataFrame({"__qk": np.arange(50)}), i, c, 64))
    assert max(map(len, got)) == 64
    rows = pd.concat(got)
    assert sorted(zip(rows["__qk"], rows["__cell"])) == sorted(zip(i, c))
