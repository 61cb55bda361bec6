"""Fill-in-middle against a walk over the units, and exact round trips."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gustlab.llm import fill_middle as M


def expected(id, text, rate=90, spm=20):
    """The definition, unit after unit."""
    t = text or ""
    units, at = [], 0
    while at < len(t):
        end = at + 1
        if re.match("[A-Za-z]", t[at]):
            while end < len(t) and re.match("[A-Za-z]", t[end]):
                end += 1
        units.append(t[at:end])
        at = end
    h = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", t, None, None
    if h4 % 100 < spm:
        return n, "spm", "<S>" + suf + "<P>" + pre + "<M>" + mid, len(pre), len(mid)
    return n, "psm", "<P>" + pre + "<S>" + suf + "<M>" + mid, len(pre), len(mid)


def texts():
    g = random.Random(3)
    kinds = ["ab", "Zz", " ", "\n", "é", "𝔸", "<", ">", "P", "S", "M", "<P", "S>", "\x00", "ſ", "K", "1"]
    out = ["", None, "<P>", "a <S> b", "<M", "P><S", "one", "\r\n" * 3, "word " * 60_000, "é" * 50_000, "x" * 200_000]
    return out + ["".join(g.choice(kinds) for _ in range(g.randrange(1, 40))) for _ in range(400)]


def test_equals_the_walk_and_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, "twice the same"), (7, "twice the same"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = M.transform(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted([(i, t, *expected(i, t), t or "") for i, t in rows], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab <PSM>é\n1"), max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cut_offsets(text, h1, h2):
    import regex

    n, i, j = M.cut(text, h1, h2, regex.compile(f"({M.UNIT})*+"))
    units = re.findall(M.UNIT, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    assert (n, text[:i], text[:j]) == (len(units), "".join(units[:a]), "".join(units[:b]))


def test_parameters_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5), (2, "d, e f", "y", 6)], "doc_id long, text string, FORM string, h long")
    got = M.transform(df, rate=100, spm=100)
    assert got.columns == ["doc_id", "text", "h", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert {r["form"] for r in got.collect()} == {"spm"}
    assert {r["form"] for r in M.transform(df, rate=0).collect()} == {"plain"}
    other = M.transform(df, rate=100, spm=0, sentinels=("[a]", "[b]", "[c]"), unit="(?s:.)", keep=["doc_id"])
    back = M.restored(F.col("output"), F.col("form"), ("[a]", "[b]", "[c]"))
    assert sorted(r[0] for r in other.select(back).collect()) == ["a b c", "d, e f"]
    assert M.transform(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.transform(df, sentinels=("<<", "<S>", "<M>"))


def test_oracle(spark):
    import duckdb

    rows = [(i, t) for i, t in enumerate(texts()) if t is None or "\x00" not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from gustlab.llm.queries import fill_middle_digests

    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = con.execute(f"SELECT {cols} FROM ({M.ORACLE}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in fill_middle_digests(df).select(*cols.split(", ")).orderBy("doc_id").collect()]
    assert got == want


def test_texts_travel_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    spark.conf.unset(key)
    try:
        M.transform(df)
        assert int(spark.conf.get(key)) == 4 << 20
        spark.conf.set(key, "1000000")
        M.transform(df)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)
