"""Hyperdimensional profiles: the vectors against brute force, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from gustlab.llm import blocks as B
from gustlab.llm import language as L
from gustlab.llm.queries import op10_language
from tests.conftest import SF_MID


def brute(t):
    out, s = np.zeros(L.DIM), []
    for c in t:
        if c.isalpha():
            s.append(ord(c))
        elif s and s[-1] != 0:
            s.append(0)
    if s:
        s = [0, *s] + ([0] if s[-1] != 0 else [])
        v = lambda c: L.letter_vectors(np.array([c]))[0].astype(float)
        for a, b, c in zip(s, s[1:], s[2:]):
            out += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    return out


def test_bundles():
    ts = ["", "a", " ab, ç!", "12 34", "été x", "日本 a", "--a--", "b", "", "a\n", "é" * 30, None]
    v, has = L.bundles(*B.utf8(pa.array(ts)))
    for t, x in zip(ts, v):
        assert np.allclose(brute(t or ""), x), t
    assert has.tolist() == [any(c.isalpha() for c in t or "") for t in ts]
    g, _ = L.bundles(*B.utf8(pa.array(ts)), groups=np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, -1]), size=2)
    assert np.allclose(g[0], sum(brute(t) for t in ts[:-1:2]))


def test_edges(spark):
    g = random.Random(0)
    rows = [(i, " ".join("".join(g.choice("abc" if i % 2 else "xyz") for _ in range(5)) for _ in range(20)), "l1" if i % 2 else "l0") for i in range(40)]
    rows += [(100, None, "l1"), (101, "", "l0"), (102, "123 !?", None), (103, "ABC cab", None), (104, "日本", None), (None, "xyz", None),
             (105, "xyzxyz " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string").withColumnRenamed("Score", "lang").repartition(3)
    model = L.fit(df.where("doc_id is not null"))
    assert sorted(model) == ["l0", "l1"]
    clash = df.withColumnRenamed("lang", "SCORE")
    got = {r["doc_id"]: r for r in L.identify(clash, model).collect()}
    assert L.identify(clash, model).columns == ["doc_id", "text", "lang_pred", "score"]
    assert all(got[i]["lang_pred"] == ("l1" if i % 2 else "l0") for i in range(40))
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, None, 105)] == ["und", "und", "und", "l1", "l0", "l0"]
    assert got[102]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert L.fit(df.limit(0)) == {} and L.identify(df.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in L.identify(df, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = op10_language(spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0


def test_bundles_hold_little_and_do_not_depend_on_the_blocks(spark, monkeypatch):
    import random
    import tracemalloc

    from gustlab.llm import blocks as B

    g = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøå"
    texts = pa.array([" ".join("".join(g.choices(letters, k=6)) for _ in range(40)) for _ in range(600)])
    data, off = B.utf8(texts)
    tracemalloc.start()
    v, has = L.bundles(data, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n_grams = len(L.ngrams(data, off)[2])
    assert has.all() and peak < 4 * L.DIM * (n_grams + 2 * len(texts)) + (40 << 20)
    monkeypatch.setattr(L, "COUNTS", 1 << 30)
    assert (L.bundles(data, off)[0] == v).all()
