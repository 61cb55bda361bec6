"""Source mixing against a plain calculation, and its edge cases."""

import random
import re

import pytest

from gustlab.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        weight = sum(w[s] for s in open_)
        over = {s for s in open_ if total * w[s] / weight >= limit * sizes[s]} if weight else set()
        if not over:
            break
        for s in over:
            out[s] = limit * sizes[s]
            total -= out[s]
        open_ -= over
    for s in open_:
        out[s] = total * w[s] / sum(w[x] for x in open_)
    return out


def corpus(n=800, seed=1):
    g = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "one", ""]
    rows = []
    for i in range(n):
        s = "hot" if g.random() < 0.4 else g.choice(names)
        rows.append((i, g.choice([" ", "\t", " \x0b"]).join("w" for _ in range(int(g.paretovariate(1.2)))), s))
    return rows + [(9000, None, "empty"), (9001, " \n", "empty"), (9002, "x" * 50, "single")]


@pytest.mark.parametrize("bin_rows", [20_000, 40])
def test_mix_meets_targets(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(M, "ROWS_PER_BIN", bin_rows)
    rows = corpus()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes, of = {}, {}
    for i, _, s in rows:
        sizes[s], of[i] = sizes.get(s, 0) + size[i], s
    want = plain_targets(sizes)
    got = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(4), keep=["doc_id"]).collect()
    again = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = of[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], abs=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    largest = {s: max(size[i] for i in of if of[i] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty).collect() == []
    one = M.mix(spark.createDataFrame([(1, "a b", None, "x")], SCHEMA + ", Size string")).collect()
    assert [(r["doc_id"], r["size"], r["target"]) for r in one] == [(1, 2, 3.0)]
    nothing = M.mix(spark.createDataFrame([(1, "", "s"), (None, None, "s")], SCHEMA), keep=["doc_id"]).collect()
    assert sorted([(r["taken"], r["copies"], r["target"]) for r in nothing]) == [(0, 0, 0.0), (0, 0, 0.0)]
    same = M.mix(spark.createDataFrame([(5, "a b c", "s")] * 4 + [(None, "x y", "s")] * 4, SCHEMA), keep=["doc_id"]).collect()
    assert len(same) == 8 and len({r["copies"] for r in same if r["doc_id"] == 5}) == 1


def test_no_python_in_the_plan(spark):
    plan = M.mix(spark.createDataFrame(corpus(50), SCHEMA), keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
