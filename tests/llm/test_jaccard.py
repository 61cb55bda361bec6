"""The Jaccard join against brute force on a planted fixture."""

import random
import re

import numpy as np
import pytest

from gustlab.llm import jaccard as J


def shingle_set(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    docs = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = {i: 0 for i, _ in docs}
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            (i, s), (j, t) = docs[a], docs[b]
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-12:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (links[i], find(i), find(i) == i) for i, _ in docs}


def corpus(n=120, seed=3):
    g = random.Random(seed)
    vocab = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 6))) for _ in range(400)]
    base = [[g.choice(vocab) for _ in range(g.choice([3, 8, 30, 60, 200]))] for _ in range(n)]
    rows = [[i, " ".join(w)] for i, w in enumerate(base)]
    k = 1000
    for _ in range(n):
        w = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 1, 2, 3, 8])):
            w[g.randrange(len(w))] = g.choice(vocab)
        rows.append([k, (", " if g.random() < 0.3 else " ").join(w).upper() if g.random() < 0.3 else " ".join(w)])
        k += 1
    rows += [[2000, ""], [2001, None], [2002, " .. "], [2003, ""], [2004, "one two"], [2005, "One, two!"]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("block", [1024, 4])
def test_join_equals_brute_force(spark, block):
    rows = corpus()
    # a hot group: 60 near copies of one long text, split over several blocks
    g = random.Random(1)
    base = [f"w{g.randrange(300)}" for _ in range(150)]
    for k in range(60):
        w = list(base)
        w[g.randrange(150)] = f"x{k}"
        rows.append((5000 + k, " ".join(w)))
    rows.append((None, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in J.join(df, block=block).collect()}
    assert got == brute(rows)


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_links int")
    assert J.join(empty).collect() == []
    one = spark.createDataFrame([(7, None)], "doc_id long, text string")
    assert [tuple(r) for r in J.join(one).collect()] == [(7, 0, 7, True)]


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "x y z u v w"), (3, "x y z u v w")]
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1)}


def test_exact_links_sparse_path(monkeypatch):
    g = np.random.default_rng(0)
    base = np.unique(g.integers(0, 1 << 60, 80, dtype=np.uint64))
    sets = [np.unique(np.append(base[: 80 - k], g.integers(0, 1 << 60, k, dtype=np.uint64))) for k in range(12)]
    side, weight = np.full(12, 2), np.arange(1, 13)
    dense = J.exact_links(sets, weight, side, 0.8)[0]
    monkeypatch.setattr(J, "MAX_BIT_BYTES", 0)
    assert (J.exact_links(sets, weight, side, 0.8)[0] == dense).all() and dense.any()
