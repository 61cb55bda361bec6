"""BM25 search with block-max WAND against brute force, and planted passages."""

import random

import numpy as np
import pytest

from gustlab.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def items(n=60, seed=2):
    g = random.Random(seed)
    common = [f"c{k}" for k in range(8)]
    return [(i, " ".join(g.choice(common) if g.random() < 0.4 else f"r{g.randrange(300)}" for _ in range(g.choice([6, 15, 30, 60]))) + ".")
            for i in range(n)]


@pytest.mark.parametrize("min_score", [0.05, 0.2, 0.6])
def test_wand_finds_all_above_the_threshold(min_score):
    rows = items()
    ix = D.Index([i for i, _ in rows], [t for _, t in rows], min_score)
    n = len(rows)
    g = np.random.default_rng(0)
    for _ in range(200):
        own = [t for t in range(len(ix.terms)) if int(g.integers(0, n)) in ix.item[ix.start[t]:ix.start[t + 1]]]
        q = sorted({*g.permutation(own)[:len(own)].tolist(), *g.integers(0, len(ix.terms), int(g.integers(0, 60))).tolist()})
        s = np.zeros(n)
        for t in q:
            s[ix.item[ix.start[t]:ix.start[t + 1]]] += ix.share[ix.start[t]:ix.start[t + 1]]
        want = {i: pytest.approx(s[i]) for i in np.flatnonzero(s >= min_score - 1e-9)}
        assert dict(ix.search(q)) == want
        half = {i: v for i, v in want.items() if 16 <= i < 32}
        assert dict(ix.search(q, 16, 32)) == half


@pytest.mark.parametrize("index_bytes", [8 << 20, 900])
def test_planted_passages(spark, index_bytes):
    rows = items()
    g = random.Random(9)
    docs, want = [], {}
    for k in range(200):
        words = [f"w{g.randrange(5000)}" if g.random() < 0.6 else f"c{g.randrange(8)}" for _ in range(g.choice([0, 5, 100, 900]))]
        if k % 4 == 0:
            i, t = g.choice(rows)
            at = g.randrange(len(words) + 1)
            words[at:at] = [g.choice([t, t.upper(), t.replace(" ", ",  ")])]
            want[k] = i
        elif k % 4 == 1:  # half an item is no leak
            t = g.choice([t for _, t in rows if len(t.split()) >= 15]).split()
            words[0:0] = t[:len(t) // 2]
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (None, rows[3][1])]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    bench = spark.createDataFrame([*rows, (None, "x y z"), (70, None), (71, "")], ITEMS)
    got = {r["doc_id"]: r for r in D.annotate(df, bench, keep=["doc_id"], max_index_bytes=index_bytes).collect()}
    for k, r in got.items():
        if k in want:
            assert want[k] in r["item_ids"] and r["contaminated"] and r["best_score"] > 0.6
        elif k is None:
            assert 3 in r["item_ids"]
        else:
            assert not r["contaminated"] and r["item_ids"] == [] and r["best_score"] is None
    none = D.annotate(df, bench.limit(0), keep=["doc_id"]).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    wide = D.annotate(df.withColumnRenamed("doc_id", "Contaminated"), bench)
    assert wide.columns == ["text", "contaminated", "item_ids", "best_score"]
    assert D.annotate(df.limit(0), bench).collect() == []


def test_words_in_order():
    g = random.Random(4)
    for _ in range(200):
        a, b = ([g.randrange(6) for _ in range(g.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D._in_order(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_copies_with_edited_and_cut_words(spark):
    size = {0: 25, 1: 12, 2: 34, 3: 60}
    rows = [(i, " ".join(f"i{i}w{j}" for j in range(k))) for i, k in size.items()]
    docs, want = [], {}

    def plant(item, change, leaked):
        words = rows[item][1].split()
        fill = [f"f{len(docs)}x{j}" for j in range(40)]
        want[len(docs)] = [item] if leaked else []
        docs.append((len(docs), " ".join(fill[:20] + change(words) + fill[20:])))

    swap = lambda j: lambda w: [*w[:j % len(w)], "other", *w[j % len(w) + 1:]]
    for item in size:
        plant(item, lambda w: w, True)
        plant(item, lambda w: w[:-1], True)  # the last word cut off
        plant(item, swap(-1), True)
        plant(item, lambda w: w[1:], True)
        plant(item, swap(0), True)
        plant(item, lambda w: w[:len(w) // 2], False)
    for j in (-2, -3, -4):
        plant(0, swap(j), True)  # 17 or more of 21 shingles are left
    plant(0, lambda w: w[:-2], True)
    plant(2, lambda w: w[:-6], False)  # 24 of 30 shingles, and no word of the answer
    got = {r["doc_id"]: r["item_ids"] for r in D.annotate(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, ITEMS), keep=["doc_id"]).collect()}
    assert got == want


def test_nearest_run_of_words():
    g = random.Random(5)
    for _ in range(300):
        words, item = [g.randrange(5) for _ in range(g.randrange(14))], [g.randrange(5) for _ in range(g.randrange(1, 9))]
        row = list(range(len(item) + 1))  # plain edit distance, free to begin anywhere
        best = (row[-1], 0)
        for j, w in enumerate(words):
            new = [0]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            if row[-1] < best[0]:
                best = (row[-1], j + 1)
        assert D._nearest(np.array(words, np.uint64), np.array(item, np.uint64)) == best


def edited(rows, seed=3, n=240):
    """Copies with a word changed, dropped or added anywhere, among common words; half copies and plain texts."""
    g = random.Random(seed)
    docs, whole = [], {}
    for k in range(n):
        fill = [f"w{g.randrange(4000)}" if g.random() < 0.5 else f"c{g.randrange(8)}" for _ in range(g.choice([3, 80, 400]))]
        i, t = rows[k % len(rows)]
        words = t.rstrip(".").split()
        at = g.randrange(len(words))
        if k % 5 == 0:
            words[at] = "other"
        elif k % 5 == 1:
            del words[at]
        elif k % 5 == 2:
            words.insert(at, "other")
        elif k % 5 == 3:
            words = words[:len(words) // 2]
        else:
            words = []
        if k % 5 < 3:
            whole[k] = i
        cut = g.randrange(len(fill) + 1)
        docs.append((k, " ".join(fill[:cut] + words + fill[cut:])))
    return docs, whole


def test_same_rows_from_one_index_and_from_many(spark):
    rows = items()
    docs, whole = edited(rows)
    df = spark.createDataFrame(docs + [(None, rows[3][1]), (900, None)], DOCS).repartition(3)
    bench = spark.createDataFrame(rows + rows[:5], ITEMS)
    read = lambda size: sorted([tuple(r) for r in D.annotate(df, bench, keep=["doc_id"], max_index_bytes=size).collect()], key=str)
    one, many = read(8 << 20), read(900)
    assert one == many and len(one) == len(docs) + 2
    found = {r[0]: r[2] for r in one}
    long = {k: i for k, i in whole.items() if len(rows[i][1].split()) >= 15}
    assert all(i in found[k] for k, i in long.items())


@pytest.mark.parametrize("words", [25, 40])
def test_every_inner_edit_is_found(spark, words):
    item = [f"i{j}" for j in range(words)]
    fill = [f"f{j}" for j in range(30)]
    docs = []
    for j in range(words):
        for copy in (item[:j] + ["other"] + item[j + 1:], item[:j] + item[j + 1:], item[:j] + ["other"] + item[j:]):
            docs.append((len(docs), " ".join(fill + copy + fill)))
    docs.append((-1, " ".join(fill + item[:words // 2] + fill + item[words // 2:][:3] + fill)))
    docs.append((-2, " ".join(reversed(item))))
    got = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(item))], ITEMS), keep=["doc_id"]).collect()
    assert all(r["contaminated"] == (r["doc_id"] >= 0) for r in got)


def test_rows_equal_a_plain_reading(spark):
    """BM25 of every item on every passage, and the acceptance rule, word by word in Python."""
    import math
    import re

    rows = items(40, seed=6)
    docs, _ = edited(rows, seed=8, n=120)
    lists = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in rows}
    n, mean, width = len(lists), sum(map(len, lists.values())) / len(lists), max(16, *map(len, lists.values()))
    df = {}
    for w in lists.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1

    def impact(x, w):
        tf = w.count(x)
        return math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    def common(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(t[j] + 1 if x == y else max(t[j + 1], new[j]))
            t = new
        return t[-1]

    def nearest(words, item):
        row, best = list(range(len(item) + 1)), (len(item), 0)
        for j, w in enumerate(words):
            new = [0]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, (row[-1], j + 1))
        return best

    def leaked(words, w):
        k = len(w)
        cut = k - max(5, k // 5) if k >= 10 else k
        both = lambda p: common(p, w[:cut]) >= 0.5 * cut and common(p, w[cut:]) >= 0.5 * (k - cut)
        grams = {tuple(w[i:i + 5]) for i in range(k - 4)}
        have = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        if len(grams & have) >= 0.8 * len(grams) and both(words):
            return True
        edits, end = nearest(words, w)
        return edits <= 0.2 * k + 1e-9 and both(words[max(0, end - k - edits):end])

    want = {}
    for d, t in docs:
        words, hits = re.findall(r"[a-z0-9]+", t.lower()), {}
        for a in range(0, max(len(words), 1), width):
            p = words[a:a + 2 * width]
            for i, w in lists.items():
                own = sum(impact(x, w) for x in set(w))
                s = sum(impact(x, w) for x in set(w) if x in p) / own
                if s >= 0.6 - 1e-9 and leaked(p, w):
                    hits[i] = max(s, hits.get(i, 0))
        want[d] = (sorted(hits), round(max(hits.values()), 9) if hits else None)
    got = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, ITEMS), keep=["doc_id"]).collect()
    assert {r["doc_id"]: (r["item_ids"], round(r["best_score"], 9) if r["best_score"] is not None else None) for r in got} == want
    assert sum(len(x) > 0 for x, _ in want.values()) > 40


def test_very_long_texts(spark):
    item = [f"i{j}" for j in range(30)]
    text = " ".join([f"w{j % 7919}" for j in range(300_000)] + item + ["end"])
    got = D.annotate(spark.createDataFrame([(1, text), (2, text.replace("i7 ", ""))], DOCS),
                     spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item * 50))], ITEMS), keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == {1: [7], 2: [7]}
