"""The manifest against a plain tree of nested lists that rebuilds everything for each changed row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gustlab.llm import merkle as M


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, fan=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def expected(rows, fan=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (first(r[0]), leaf_of(r))) for s in sources}
    trees = {s: levels_of([leaf_of(r) for r in by[s]], fan) for s in sources}
    over = levels_of([trees[s][-1][0] for s in sources], fan)
    root, out = over[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            proof = ""
            for tree, at in ((trees[s], i), (over, k)):
                for lv in tree[:-1]:
                    run = at // fan * fan
                    proof += "".join(lv[j] for j in range(run, min(run + fan, len(lv))) if j != at)
                    at //= fan
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            t = r[4]
            if bad and t is not None:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            leaves = [leaf_of(x) for x in by[s]]
            leaves[i] = leaf_of((*r[:4], t))
            tops = [trees[x][-1][0] for x in sources]
            tops[k] = levels_of(leaves, fan)[-1][0]
            folded = levels_of(tops, fan)[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, sha(proof), folded, folded == root))
    return sorted(out, key=str)


def digests(df, **kw):
    got = M.proofs(df, changed={"text": M.lower_ascii(F.col("text"))}, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **kw)
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")


def rows_of(sizes, seed=0):
    g = random.Random(seed)
    letters = ["A", "b", "É", "Z", " ", "\n", "日", "-", ":", ""]
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            t = g.choice([None, "", "Same Text", "plain", "".join(g.choice(letters) for _ in range(12))])
            out.append((len(out) * 3 % 1009, s, g.choice([None, "en", "de"]), g.choice([None, 0, 7, -1]), t))
    g.shuffle(out)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [
    {"hot": 700, None: 40, "one": 1, "": 17, "é": 16, "z": 257, "Z": 2},
    {f"s{i}": 1 + i % 3 for i in range(40)},
    {"only": 1}, {"only": 16}, {None: 300},
], ids=["hot", "many sources", "one row", "one run", "null source"])
def test_equals_the_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted([tuple(r) for r in digests(df).collect()], key=str) == expected(rows)


def test_more_levels_than_steps(spark):
    rows = rows_of({"a": 150, "b": 9, None: 3}, seed=2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted([tuple(r) for r in digests(df, fan=2, levels=2).collect()], key=str) == expected(rows, fan=2)


def test_repeated_rows_null_ids_long_texts(spark):
    rows = [(5, "a", "en", 1, "Two"), (5, "a", "en", 1, "Two"), (5, "a", "en", 1, "other"), (None, "a", None, None, None),
            (None, None, "x", 2, "Null Id"), (10, None, "x", 2, "L" * 2_000_000), (15, "a", "b", 3, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.select("*", F.lit(1).alias("leaf"), F.lit("x").alias("ROOT"), F.lit(2).alias("pos"))
    assert sorted([tuple(r) for r in digests(extra).collect()], key=str) == expected(rows)
    assert digests(df.limit(0)).collect() == []


def test_untouched_rows_verify_and_changes_show(spark):
    rows = rows_of({"a": 60, "b": 20}, seed=4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.proofs(df).where("not verified").count() == 0
    other = M.proofs(df, changed={"lang": F.lit("xx")}, tampered=F.lit(True))
    assert other.where("verified").count() == 0


def test_manifest(spark):
    rows = rows_of({"a": 60, None: 20, "é": 1}, seed=4)
    got = M.manifest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    want = expected(rows)
    assert [(r["rank"], r["source"], r["leaves"]) for r in got] == [(0, None, 20), (1, "a", 60), (2, "é", 1)]
    assert {(r["subroot"], r["root"]) for r in got} == {(w[2], w[3]) for w in want}


def test_states_resume():
    nodes = [sha(str(i)).encode() for i in range(100)]
    for levels in (1, 2):
        t = M.Subtree(nodes, levels)
        whole = levels_of([n.decode() for n in nodes])[levels]
        assert [x.decode() for x in t.top] == whole
        for i in (0, 15, 16, 99):
            assert t.fold(i, nodes[i]).decode() == whole[i // 16 ** levels]
            other = [*nodes[:i], b"0" * 64, *nodes[i + 1:]]
            assert t.fold(i, b"0" * 64).decode() == levels_of([n.decode() for n in other])[levels][i // 16 ** levels]


def test_oracle(spark):
    import duckdb

    rows = rows_of({"hot": 300, None: 5, "one": 1, "b": 40})
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(M.ORACLE).fetchall(), key=str) == expected(rows)
