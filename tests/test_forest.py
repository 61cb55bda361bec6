"""Full-depth trees, out-of-bag errors and importances against a plain recursive tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustlab.operators import forest as FO


def plain(x, y, w, mtry, node_size, seed, tree):
    """A tree of nested tuples: every split of every tried input is scored from its definition."""
    k = x.shape[1]

    def build(rows, way):
        n, mean = w[rows].sum(), np.average(y[rows], weights=w[rows])
        if n <= node_size:
            return mean
        draws = [int(FO._salted(np.array([way], np.uint64), f)[0]) for f in range(k)]
        tried = sorted(sorted(range(k), key=lambda f: (draws[f], f))[:mtry])
        sse = lambda r: (w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum()
        best, whole = None, sse(rows)
        for f in tried:
            for b in np.unique(x[rows, f])[:-1]:
                gain = whole - sse(rows[x[rows, f] <= b]) - sse(rows[x[rows, f] > b])
                if gain > 1e-9 * (1 + whole) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, b)
        if best is None:
            return mean
        _, f, b = best
        go = x[rows, f] <= b
        with np.errstate(over="ignore"):
            ways = FO._mix(np.array([way, way], np.uint64) + np.array([1, 2], np.uint64))
        return f, b, build(rows[go], ways[0]), build(rows[~go], ways[1])

    return build(np.arange(len(y)), FO._salted(np.zeros(1, np.uint64), seed, tree, 7)[0])


def walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def data(n, seed=0, k=4):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, k))
    return x, 5 * x[:, 0] + np.where(x[:, 1] > 0, 3.0, 0.0) + 0.3 * g.normal(size=n)


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double")


@pytest.mark.parametrize("mtry, node_size", [(4, 5), (2, 1), (1, 20)])
def test_tree_equals_the_plain_tree(mtry, node_size):
    g = np.random.default_rng(1)
    x = np.column_stack([g.permutation(250), g.integers(0, 9, 250), g.integers(0, 200, 250), np.full(250, 3)]).astype(np.uint8)
    y, w = x[:, 0] * 0.5 + g.normal(size=250) * 9, g.integers(1, 4, 250)
    for tree in range(4):
        t = FO.grow(x, y, w, mtry, node_size, 123, tree)
        want = plain(x, y, w, mtry, node_size, 123, tree)
        other = g.integers(0, 256, (400, 4)).astype(np.uint8)
        for rows in (x, other):
            assert np.allclose(t.predict(rows), [walk(want, r) for r in rows], atol=1e-8)


def test_both_searches_agree(monkeypatch):
    g = np.random.default_rng(2)
    x, y = g.integers(0, 256, (4000, 3)).astype(np.uint8), g.normal(size=4000)
    a = FO.grow(x, y, np.ones(4000), 3, 5, 1, 0)
    monkeypatch.setattr(FO, "_best_few", FO._best_many)
    b = FO.grow(x, y, np.ones(4000), 3, 5, 1, 0)
    assert np.allclose(a.predict(x), b.predict(x)) and len(a.value) == len(b.value)


def test_weights():
    h = np.random.default_rng(3).integers(0, 2**63, 200_000).astype(np.uint64)
    for rate in (1.0, 0.1):
        w = FO.weights(h, 3, 1, rate)
        assert abs(w.mean() - rate) < 0.01 and abs((w == 0).mean() - np.exp(-rate)) < 0.01
    assert abs(np.corrcoef(FO.weights(h, 1, 1), FO.weights(h, 2, 1))[0, 1]) < 0.02


def test_forest_and_importance_equal_plain_ones(spark):
    """200 rows: predictions, out-of-bag errors and permuted errors of plain trees."""
    x, y = data(200)
    df = frame(spark, x, y).repartition(3)
    forest = FO.fit_forest(df, ["x0", "x1", "x2", "x3"], "y", ["id"], num_trees=7, mtry=2, trees_a_batch=3)
    h = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    b = FO.binned(x, [np.unique(x[:, i]) for i in range(4)])
    order = np.argsort(h)
    b, yy, h = b[order], y[order], h[order]
    oob = {r["tree"]: r for r in forest.out_of_bag(df).collect()}
    rises, total = np.zeros((7, 4)), np.zeros(200)
    for tree in range(7):
        w = FO.weights(h, tree, 123)
        t = plain(b[w > 0], yy[w > 0], w[w > 0], 2, 5, 123, tree)
        total += [walk(t, r) for r in b]
        out = w == 0
        sse = sum((walk(t, r) - v) ** 2 for r, v in zip(b[out], yy[out]))
        assert oob[tree]["n"] == out.sum() and abs(oob[tree]["sse"] - sse) < 1e-6
        for f in range(4):
            other, draw = b[out].copy(), FO._salted(h[out], 123, tree, 1000 + f)
            other[:, f] = b[out][np.argsort(draw), f]
            perm = sum((walk(t, r) - v) ** 2 for r, v in zip(other, yy[out]))
            assert abs(oob[tree]["permuted"][f] - perm) < 1e-6
            rises[tree, f] = (perm - sse) / out.sum()
    got = {r["feature"]: r for r in forest.importance(df).collect()}
    for f in range(4):
        assert abs(got[f"x{f}"]["importance"] - rises[:, f].mean()) < 1e-8
        assert abs(got[f"x{f}"]["scaled"] - rises[:, f].mean() / (rises[:, f].std(ddof=1) / np.sqrt(7))) < 1e-6
    pred = np.array([r[0] for r in forest.predict(df).orderBy("id").select("prediction").collect()])[order]
    assert np.allclose(pred, total / 7, atol=1e-8)


def test_planted_input_first_and_noise_near_zero(spark):
    x, y = data(1500, seed=4, k=5)
    df = frame(spark, x, y)
    forest = FO.fit_forest(df, [f"x{i}" for i in range(5)], "y", ["id"], num_trees=60, mtry=2)
    got = {r["feature"]: r["importance"] for r in forest.importance(df, chunk_rows=400).collect()}
    assert max(got, key=got.get) == "x0" and got["x1"] > 0.5
    assert all(abs(got[f"x{i}"]) < 0.05 * got["x0"] for i in (2, 3, 4))
    e = forest.out_of_bag(df).agg(F.sum("sse") / F.sum("n")).first()[0]
    assert e < 0.25 * np.var(y)


def test_order_of_arrival_chunks_and_sampling(spark):
    x, y = data(900, seed=5)
    df = frame(spark, x, y)
    f = ["x0", "x1", "x2", "x3"]
    a = FO.fit_forest(df, f, "y", ["id"], num_trees=5, mtry=2)
    b = FO.fit_forest(df.orderBy(F.rand(1)).repartition(7), f, "y", ["id"], num_trees=5, mtry=2, chunk_rows=100, trees_a_batch=2)
    pa, pb = ([r[0] for r in m.predict(df, chunk_rows=n).orderBy("id").select("prediction").collect()] for m, n in ((a, 10_000), (b, 77)))
    assert np.allclose(pa, pb)
    few = FO.fit_forest(df, f, "y", ["id"], num_trees=40, mtry=2, sample_rows=200)
    h = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    want = [int((FO.weights(h, i, 123, 200 / 900) == 0).sum()) for i in range(40)]
    assert [r["n"] for r in few.out_of_bag(df).orderBy("tree").collect()] == want
    p = few.predict(df).select("y", "prediction").toPandas()
    assert ((p.y - p.prediction) ** 2).mean() < 0.3 * p.y.var()


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, None, 3.0), (3, 4.0, None), (None, 5.0, 9.0)], "id long, x double, y double")
    forest = FO.fit_forest(df, ["x"], "y", ["id"], num_trees=20, node_size=1)
    got = sorted([tuple(r) for r in forest.predict(df).collect()], key=str)
    assert len(got) == 5 and [r[3] is None for r in got if r[1] is None] == [True]
    assert all(2.0 <= r[3] <= 9.0 for r in got if r[1] is not None)
    none = FO.fit_forest(df.limit(0), ["x"], "y", ["id"], num_trees=3)
    assert none.trees.count() == 0 and [r["prediction"] for r in none.predict(df).collect()] == [None] * 5


def test_edges_of_many_values(spark):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("double").alias("z"), F.lit(2.0).alias("c"))
    e = FO.bin_edges(df, ["x", "z", "c"])
    assert 200 < len(e[0]) <= 256 and e[1].tolist() == [0, 1, 2] and e[2].tolist() == [2]
    b = FO.binned(np.array([[0.0, 1, 2], [7498.5, 2, 3], [1e9, 9, 9]]), e)
    assert b[0].tolist() == [0, 1, 0] and b[1, 1] == 2 and (b[2] == [len(v) - 1 for v in e]).all()


def test_pieces_grow_the_whole_tree(monkeypatch):
    """Cut into pieces of a few rows, with inputs of few and of many bins, a tree stays the tree of all rows."""
    g = np.random.default_rng(6)
    x = np.column_stack([g.integers(0, 256, 6000), g.integers(0, 5, 6000), g.integers(0, 90, 6000)]).astype(np.uint8)
    y, w = x[:, 0] + 40.0 * x[:, 1] + g.normal(size=6000), g.integers(1, 4, 6000)
    whole = FO.grow(x, y, w, 2, 5, 123, 3)
    for rows in (1, 50, 2000):
        monkeypatch.setattr(FO, "PIECE_ROWS", rows)
        t = FO.grow(x, y, w, 2, 5, 123, 3)
        assert len(t.value) == len(whole.value) and np.allclose(t.predict(x), whole.predict(x), atol=1e-8)
        inner = t.feature >= 0
        assert sorted([*t.left[inner], *(t.left[inner] + 1)]) == list(range(1, len(t.value)))


def test_rows_are_read_a_step_at_a_time(monkeypatch):
    g = np.random.default_rng(7)
    x, y = g.integers(0, 256, (3000, 3)).astype(np.uint8), g.normal(size=3000)
    t = FO.grow(x, y, np.ones(3000), 2, 5, 1, 0)
    at = np.zeros(3000, np.int64)
    for _ in range(60):
        f = t.feature[at]
        at = np.where(f >= 0, t.left[at] + (x[np.arange(3000), f] > t.split[at]), at)
    monkeypatch.setattr(FO, "STEP_ROWS", 700)
    assert (t.feature[at] == -1).all() and (t.leaves(x) == at).all() and (t.predict(x) == t.value[at]).all()


def test_scoring_chunks_and_missing_trees(spark):
    """Any number of chunks and of trees a batch gives the same predictions; trees whose sample was empty do not count."""
    df = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(3)], "id long, x double, y double")
    forest = FO.fit_forest(df, ["x"], "y", ["id"], num_trees=40, node_size=1, sample_rows=1)
    trees = sorted(r[0] for r in forest.trees.select("tree").collect())
    assert len(trees) < trees[-1] + 1 and forest.num_trees == len(trees)
    one, many = ([r[0] for r in forest.predict(df, chunk_rows=n).orderBy("id").select("prediction").collect()] for n in (10, 1))
    by_hand = np.mean([FO._tree(t, 0).predict(np.array([[0], [1], [0]], np.uint8)) for t in
                       (forest.trees.where(F.col("tree") == i).toArrow() for i in trees)], axis=0)
    assert np.allclose(one, many) and np.allclose(one, by_hand)


def test_mirrored_inputs_tie_at_any_size():
    """A mirrored input splits as the input itself does, so the first of the two is always taken, also in trees of many rows."""
    g = np.random.default_rng(8)
    a, y = g.integers(0, 256, (200_000, 2)).astype(np.uint8), g.uniform(0, 9e4, 200_000)
    t = FO.grow(np.column_stack([a, 255 - a]), y, np.ones(200_000), 4, 5, 1, 0)
    assert np.bincount(t.feature[t.feature >= 0], minlength=4)[2:].tolist() == [0, 0]


def test_every_row_counts_above_the_rows_of_a_task(spark, monkeypatch):
    """More rows than a task holds thin out no weights: trees in pieces are the trees of all rows, and score and permute as these do."""
    x, y = data(1500, seed=9)
    df = frame(spark, x, y)
    f = ["x0", "x1", "x2", "x3"]
    whole = FO.fit_forest(df, f, "y", ["id"], num_trees=4, mtry=2)
    monkeypatch.setattr(FO, "TASK_ROWS", 300)
    parts = FO.fit_forest(df.repartition(5), f, "y", ["id"], num_trees=4, mtry=2, chunk_rows=200, task_rows=FO.TASK_ROWS)
    assert parts.rate == 1.0 and parts.num_trees == 4 and parts.trees.agg(F.max("piece")).first()[0] >= 3
    leaves = lambda m: {r["tree"]: sum(1 for v in np.frombuffer(r["feature"], np.int16) if v >= 0) for r in m.trees.where("piece = 0").collect()}
    assert all(v < leaves(whole)[t] for t, v in leaves(parts).items())  # no task grew a whole tree
    a, b = ([r[0] for r in m.predict(df, chunk_rows=400).orderBy("id").select("prediction").collect()] for m in (whole, parts))
    assert np.allclose(a, b, atol=1e-8)
    a, b = ({r["tree"]: r for r in m.out_of_bag(df, chunk_rows=10_000).collect()} for m in (whole, parts))
    assert a.keys() == b.keys() and all(a[t]["n"] == b[t]["n"] and np.allclose(a[t]["permuted"], b[t]["permuted"]) for t in a)


def test_no_sample_by_default():
    import inspect

    assert inspect.signature(FO.fit_forest).parameters["sample_rows"].default is None


def test_pieces_of_labels_that_cannot_be_split(spark):
    df = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("x"), F.lit(3.0).alias("y"))
    forest = FO.fit_forest(df, ["x"], "y", ["id"], num_trees=3, task_rows=50)
    assert forest.num_trees == 3 and {r["prediction"] for r in forest.predict(df).collect()} == {3.0}
