"""The toxicity network: gradients against differences, windows, and held-out accuracy on planted words."""

import random

import numpy as np
import pyarrow as pa

from gustlab.llm import blocks as B
from gustlab.llm import toxicity as T


def test_gradients_match_differences():
    w = T.Words(*B.utf8(pa.array(["the cat sat on a mat", "dog " * 50, "a"])))
    m = T.new_model(w.hash, np.zeros(len(w.hash), np.float32), np.zeros(T.BUCKETS, np.float32))
    m = {k: (v.astype(np.float64) if v.dtype == np.float32 else v) for k, v in m.items()}
    idx, live = T._grid(w, *w.windows()[:2])
    x = np.random.default_rng(0).standard_normal((len(w.hash), T.D_WORD + T.D_CHAR))

    def loss(model, x):
        return float((T.forward(model, x, idx, live)[0] ** 2).sum() / 2)

    z, saved = T.forward(m, x, idx, live, keep=True)
    g, dx = T.backward(m, x, idx, live, saved, z)
    for k in ("Wf", "Uf", "cf", "Wb", "Ub", "cb", "att", "out", "bias"):
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        for sign in (1,):
            e = 1e-3
            hi, lo = {**m, k: m[k].copy()}, {**m, k: m[k].copy()}
            hi[k][at] += e * sign
            lo[k][at] -= e * sign
            assert abs((loss(hi, x) - loss(lo, x)) / (2 * e) - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k
    at = np.unravel_index(np.abs(dx).argmax(), dx.shape)
    hi, lo = x.copy(), x.copy()
    hi[at] += 1e-3
    lo[at] -= 1e-3
    assert abs((loss(m, hi) - loss(m, lo)) / 2e-3 - dx[at]) < 2e-2 * max(1, abs(dx[at]))


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = T.Words(*B.utf8(pa.array(["x", " ".join("w" for _ in range(n)), ""])))
        begin, length, row = w.windows()
        covered = np.zeros(n + 1, int)
        for b, k, r in zip(begin, length, row):
            if r == 1:
                covered[b:b + k] += 1
        assert (covered[1:] > 0).all() and (row != 2).all()


def planted(n, seed):
    """Toxic texts hold two words of a family that shares a beginning, or a fixed word; clean texts never."""
    g = random.Random(seed)
    syl = ["ba", "re", "ti", "on", "es", "lu", "mo"]
    word = lambda: "".join(g.choice(syl) for _ in range(g.randint(1, 4)))
    bad = lambda: g.choice(["vileone", "zorg" + word(), "zorg" + word()])
    texts, y = [], []
    for _ in range(n):
        w = [word() for _ in range(g.choice([4, 40, 200]))]
        y.append(int(g.random() < 0.3))
        for _ in range(2 * y[-1]):
            w[g.randrange(len(w))] = bad()
        texts.append(" ".join(w))
    return texts, np.array(y)


def test_spark_scores(spark):
    texts, y = planted(700, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "!"), (None, texts[0]),
                                                                        (9003, "ba re ti " * 30_000), (9004, "ba re ti " * 30_000 + "zorgba vileone zorglu")],
                                 "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (3, 1 - int(y[3])), (4, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels, learn=lambda c: c % 3 != 1)
    got = {r["doc_id"]: r for r in T.score(docs.withColumnRenamed("text", "t").withColumn("Score", docs["doc_id"]), model, text="t").collect()}
    held = [i for i in range(700) if i % 3 == 1]
    assert sum(got[i]["predicted"] == y[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert [got[i]["predicted"] for i in (9000, 9001, 9002, 9003, 9004)] == [0, 0, 0, 0, 1]
    assert T.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert T.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert [tuple(r) for r in T.score(docs, None).collect()] == [(1, "a b", 0.0, 0)]
