"""Forests grown level by level against plain recursive trees, alone and inside cross-validation and elimination."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import forest as FO
from gustlab.operators import levels as L
from gustlab.operators import models as M

X = ["x0", "x1", "x2", "x3"]


def frame(spark, n, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 4))
    x[:, 2] = g.integers(0, 3, n)
    y = 5 * x[:, 0] + np.where(x[:, 1] > 0, 3.0, 0.0) + 0.3 * g.normal(size=n)
    rows = [(i, *map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, y double, part int")


def plain(x, y, w, mtry, depth, seed, tree, inputs, gains):
    """A tree of nested tuples, every split scored from its definition."""
    def build(rows, way, level):
        rows = rows[w[rows] > 0]
        n, mean = w[rows].sum(), np.average(y[rows], weights=w[rows])
        if n <= 1 or level == depth:
            return mean
        draws = [int(FO._salted(np.array([way], np.uint64), f)[0]) for f in inputs]
        tried = sorted(sorted(range(len(inputs)), key=lambda j: (draws[j], j))[:mtry])
        sse = lambda r: (w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum()
        best, whole = None, sse(rows)
        for f in (inputs[j] for j in tried):
            for b in np.unique(x[rows, f])[:-1]:
                gain = whole - sse(rows[x[rows, f] <= b]) - sse(rows[x[rows, f] > b])
                if gain > 1e-9 * (1 + whole) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, b)
        if best is None:
            return mean
        gain, f, b = best
        gains[f] += gain
        go = x[rows, f] <= b
        with np.errstate(over="ignore"):
            ways = FO._mix(np.array([way, way], np.uint64) + np.array([1, 2], np.uint64))
        return f, b, build(rows[go], ways[0], level + 1), build(rows[~go], ways[1], level + 1)

    return build(np.arange(len(y)), FO._salted(np.zeros(1, np.uint64), seed, tree, 7)[0], 0)


def walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def packed_rows(p):
    """Inputs, labels, folds and the weights' keys of all rows of all blocks."""
    out = []
    for r in p.blocks.collect():
        y = np.frombuffer(r["y"])
        out.append((np.frombuffer(r["x"], np.uint8).reshape(len(p.inputs), -1).T, y, np.frombuffer(r["fold"], np.uint8), (r["chunk"], r["block"])))
    return out


@pytest.mark.parametrize("sum_bytes", [L.SUM_BYTES, 4000])
def test_trees_and_importances_equal_plain_ones(spark, monkeypatch, sum_bytes):
    """Three forests grown together, one without a fold, one of two inputs: every tree is that of all rows of its draw."""
    monkeypatch.setattr(L, "SUM_BYTES", sum_bytes)
    df = frame(spark, 400)
    p = L.pack(df.repartition(5), X, "y", "part", chunk_rows=90)
    blocks = packed_rows(p)
    assert len(blocks) > 2 and sum(len(b[1]) for b in blocks) == 400
    x, y, fold = (np.concatenate([b[i] for b in blocks]) for i in range(3))
    base = dict(num_trees=3, mtry=2, max_depth=4, seed=123)
    asked = [base, {**base, "without": 1}, {**base, "features": ["x3", "x0"], "mtry": 1, "seed": 5}]
    for s, f in zip(asked, L.fit_level_forests(p, asked)):
        inputs = [X.index(c) for c in s.get("features", X)]
        total, gains = np.zeros(400), np.zeros((3, 4))
        for tree in range(3):
            w = np.concatenate([L.poisson(len(b[1]), s["seed"], tree, *b[3]) for b in blocks])
            w = np.where(fold == s.get("without", -1), 0, w).astype(int)
            t = plain(x, y, w, s["mtry"], 4, s["seed"], tree, inputs, gains[tree])
            total += [walk(t, r) for r in x]
            assert (f.trees[tree].feature >= 0).sum() > 3
        got = sum(t.predict(np.ascontiguousarray(x[:, inputs])) for t in f.trees)
        assert np.allclose(got, total, atol=1e-8)
        share = (gains / gains.sum(axis=1, keepdims=True)).sum(axis=0)[inputs]
        assert np.allclose(f.importances(), share / share.sum())


def test_poisson_draws():
    w = L.poisson(400_001, 123, 4, 0, 0)
    assert len(w) == 400_001 and abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.005 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, L.poisson(400_001, 123, 5, 0, 0))[0, 1]) < 0.01


def test_edges_come_from_all_rows(spark):
    """Few values are all kept, many give quantiles of all rows; a value of most rows takes one bin."""
    n = 30_000
    df = spark.range(n).select(F.lit(1.0).alias("y"), (F.col("id") % 7).cast("double").alias("f0"), ((F.col("id") * 7919) % n).cast("double").alias("f1"),
                               F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("f2"))
    e, count, mean = L.find_edges(df.withColumn("h", F.lit(0)).select("h", "y", "f0", "f1", "f2"), 3, chunk_rows=2500)
    assert count == n and mean == 1.0 and e[0].tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert len(e[1]) == 32 and e[1][-1] == n - 1 and np.abs(e[1] - np.arange(1, 33) / 32 * n).max() < 2 * n / L.SKETCH
    assert 5.0 in e[2] and e[2][-1] == n - 10 and len(e[2]) < 32


def test_order_of_arrival_and_equal_rows(spark, monkeypatch):
    """Rows in another order and layout give the same forest; equal rows draw on their own."""
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    df = frame(spark, 300, seed=2)
    a, b = (M.fit_random_forest(d, X, "y", num_trees=3) for d in (df, df.orderBy(F.rand(1)).repartition(6)))
    assert np.allclose(*([r[0] for r in m.predict(df).orderBy("id").select("prediction").collect()] for m in (a, b)))
    one = spark.range(25_000).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    rows = packed_rows(L.pack(one, ["x"], "y", chunk_rows=5000))
    assert sum(len(r[1]) for r in rows) == 25_000 and len(rows) > 1
    w = np.concatenate([L.poisson(len(r[1]), 1, 0, *r[3]) for r in rows])
    assert abs((w == 0).mean() - np.exp(-1)) < 0.02


def test_nulls_and_wrong_values(spark, monkeypatch):
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    df = spark.createDataFrame([(float(i), float(i % 3), float(2 * i)) for i in range(40)] + [(None, 1.0, 3.0), (5.0, 1.0, None)],
                               "a double, b double, y double")
    fm = M.fit_random_forest(df, ["a", "b"], "y", num_trees=3)
    out = fm.predict(df, "p").collect()
    assert fm.forest is not None and len(out) == 42 and [r["p"] is None for r in out if r["a"] is None] == [True]
    assert all(0 <= r["p"] <= 78 for r in out if r["a"] is not None)
    same = M.fit_random_forest(df.where("a is not null").withColumn("y", F.lit(4.0)), ["a", "b"], "y", num_trees=2)
    assert {r["prediction"] for r in same.predict(df.where("a is not null")).collect()} == {4.0}
    assert [i for _, i in same.importances()] == [0.0, 0.0]


def test_forest_is_as_good_as_mllibs(spark, monkeypatch):
    df = frame(spark, 4000, seed=3)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0").cache()
    err, imp = [], []
    for rows in (1 << 40, 0):
        monkeypatch.setattr(M, "MLLIB_ROWS", rows)
        fm = M.fit_random_forest(train, X, "y", num_trees=20, mtry=2)
        assert (fm.forest is None) == (rows > 0)
        err.append(M.regression_metrics(fm.predict(test), "y", "prediction").first()["rmse"])
        imp.append(np.array([v for _, v in fm.importances()]))
    assert abs(err[0] / err[1] - 1) < 0.1 and np.abs(imp[0] - imp[1]).max() < 0.05


def test_cross_validation_and_elimination_of_many_rows(spark, monkeypatch):
    """Every fold is scored by a forest that has not seen it; metrics are near those of MLlib's forests."""
    df = frame(spark, 1500, seed=4)
    cv, rfe = [], []
    for rows in (1 << 40, 0):
        monkeypatch.setattr(M, "MLLIB_ROWS", rows)
        cv.append({(r["repeat"], r["fold"]): r for r in M.repeated_cv(df, X, "y", ["id"], folds=3, repeats=2, num_trees=10, mtry=2).collect()})
        rfe.append({r["n_features"]: r for r in M.rfe(df, X, "y", ["id"], folds=2, sizes=[1, 2, 4], num_trees=10, mtry=2).collect()})
    assert cv[0].keys() == cv[1].keys() and len(cv[0]) == 6
    assert all(cv[0][k]["n"] == cv[1][k]["n"] and abs(cv[0][k]["rmse"] / cv[1][k]["rmse"] - 1) < 0.2 for k in cv[0])
    assert {k: r["features"] for k, r in rfe[0].items() if k != 4} == {k: r["features"] for k, r in rfe[1].items() if k != 4} == {2: "x0,x1", 1: "x0"}
    assert all(abs(rfe[0][k]["rmse"] / rfe[1][k]["rmse"] - 1) < 0.2 for k in rfe[0])


def test_passes_do_not_grow_with_the_forests(spark, monkeypatch):
    """Two forests of many rows take as many Spark jobs as seven."""
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    sc, jobs = spark.sparkContext, []
    df = frame(spark, 300, seed=5).cache()
    df.count()
    for n in (2, 7):
        sc.setJobGroup(f"levels-{n}", "")
        M.fit_random_forests(df, "y", [dict(features=X, num_trees=2, mtry=1 + i % 4, max_depth=3) for i in range(n)])
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"levels-{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
