"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from gustlab.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, np.float64), l) for i, v, l in rows
          if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = sorted({i for i, _, _ in rows if i is not None})
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, v, l), (j, w, m) = ok[a], ok[b]
            if i != j and l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def planted(n=900, d=16, seed=0):
    g = np.random.default_rng(seed)
    base = g.standard_normal((n, d)).astype(np.float32)
    rows = [(i, base[i].tolist(), i % 3) for i in range(n)]
    for k in range(300):  # near copies at all distances from the threshold, some of other labels
        i = int(g.integers(0, n))
        noise = g.standard_normal(d) * np.linalg.norm(base[i]) / np.sqrt(d) * g.choice([0.05, 0.1, 0.15, 0.2, 0.25])
        rows.append((n + k, (base[i] * g.choice([1, 3]) + noise).astype(np.float32).tolist(), i % 3 if g.random() < 0.9 else 1))
    hot = g.standard_normal(d)
    rows += [(5000 + k, (hot + g.standard_normal(d) * 0.03).astype(np.float32).tolist(), 0) for k in range(150)]
    rows += [(6000 + k, hot.astype(np.float32).tolist(), 0) for k in range(100)]
    return rows


@pytest.mark.parametrize("cap", [2048, 60])
def test_links_equal_brute_force(spark, cap):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in E.near_duplicates(df, shard=100, cap=cap).collect()}
    want = brute(rows)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert got.keys() == want.keys()
    assert found >= 0.99 * true and all(got[i][0] <= want[i][0] for i in want)
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.98 * len(want)


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0, 2.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [0.0, 0.0], 0),
            (7, [1.0, float("nan")], 0), (8, [1.0, float("inf")], 0), (9, [1.0, None], 0), (10, [], 0), (11, [2.0, 4.0], 0),
            (12, [1.0, 2.0, 0.0], 0), (13, one, 1), (2, one, 0), (None, one, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_links", __import__("pyspark").sql.functions.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in E.near_duplicates(df).collect()}
    want = {i: (0, i, True) for i in range(1, 14)}
    want[1], want[2], want[11] = (2, 1, True), (2, 1, False), (2, 1, False)
    assert got == want
    assert E.near_duplicates(df.limit(0)).collect() == []


def test_search_expands_the_range_from_the_medoid():
    g = np.random.default_rng(1)
    x = g.standard_normal((400, 8))
    x[:80] = x[0] + g.standard_normal((80, 8)) * 0.05
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    adj = E.both_ways(E.build(x))
    assert max(len(a) for a in adj) < 400
    q, y = E.range_search(x, x, int((x @ x.mean(0)).argmax()), adj, 0.98)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.98))}
    assert len({*zip(q.tolist(), y.tolist())} & want) >= 0.99 * len(want)
