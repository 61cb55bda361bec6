"""The corpus pipeline against brute force on a small planted corpus, and each stage's edge cases."""

import random
import zlib

import pytest

import corpus_pipeline as P
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_mixing import plain_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYL = {"xx": ["ba", "re", "ti", "on", "es", "lu"], "yy": ["ku", "wo", "zhe", "miy", "ak", "oj"]}


def corpus(seed=0, n=420):
    """Rows, labels, benchmark, and the ids that the stages must drop by their plain definitions."""
    g = random.Random(seed)

    def words(lang, k):
        return ["".join(g.choice(SYL[lang]) for _ in range(g.randint(2, 5))) for _ in range(k)]

    bench = [(i, " ".join(words("xx", 25))) for i in range(12)]
    rows, labels, toxic, leaked, foreign = [], [], set(), set(), set()
    for i in range(n):
        lang = "xx" if i % 3 else "yy"
        w = words(lang, g.choice([40, 90, 200]))
        if g.random() < 0.25:
            toxic.add(i)
            for _ in range(4):
                w[g.randrange(len(w))] = "vileword" if lang == "xx" else "grotterm"
        elif g.random() < 0.1:
            leaked.add(i)
            w[5:5] = g.choice(bench)[1].split()
        elif g.random() < 0.05:
            foreign.add(i)
            w = ["1234", "%&", "56"]
        labels.append((i, g.randint(0, 1), int(i in toxic)))
        rows.append([i, " ".join(w), lang, f"s{i % 4}" if i % 9 else None])
    clean = [r for r in rows if r[0] not in toxic | leaked | foreign]
    for k in range(60):  # copies, exact and near
        src = list(g.choice(clean))
        w = src[1].split()
        if len(w) > 80 and k % 2:
            w[g.randrange(len(w))] = "other"
        rows.append([1000 + k, " ".join(w), src[2], src[3]])
    rows += [[2000, None, "xx", "s0"], [2001, "", "xx", "s1"]]
    foreign |= {2000, 2001}
    return [(*r, len(r[1] or "")) for r in rows], labels, bench, toxic, foreign, leaked


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rows, labels, bench, toxic, foreign, leaked = corpus()
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, toxic, foreign, leaked


def test_run_equals_the_plain_definitions(spark, planted):
    d, rows, toxic, foreign, leaked = planted
    left = [r for r in rows if r[0] not in toxic | foreign]
    kept = {i for i, (_, _, k) in jaccard_brute([(r[0], r[1]) for r in left]).items() if k}
    left = [r for r in left if r[0] in kept and r[0] not in leaked]
    got = P.run(spark, d).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in left)
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in got} == {r[0]: r[1:] for r in left}
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = plain_targets(sizes)
    for s, t in want.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(t) for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["size"] for r in own) / 2 + 1e-6


def test_stages_keep_the_columns(spark, planted):
    from pyspark.sql import functions as F

    d, rows, *_ = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "lang_pred", "contaminated", "item_ids", "row", "component_id",
                                                   "kept", "count", "n_links", "t", "id")})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, d)
        assert out.columns == wide.columns, name
        assert 0 < out.count() <= len(rows), name


def test_stages_take_odd_rows(spark, planted):
    d, rows, *_ = planted
    odd = [(None, None, None, None, None), (None, "ba re ti", None, None, None), (5, "", None, None, None), (5, "ba re", None, None, None),
           (5, "ba re", None, None, None), (6, "bare " * 50_000, "xx", "s", 1), (7, "...", "yy", "s", 1)]
    docs = spark.createDataFrame(odd + [(r[0] + 10_000, *r[1:]) for r in rows[:60]], DOCS)
    for name, stage in P.STAGES:
        got = stage(spark, docs, d).collect()
        assert 0 < len(got) <= len(odd) + 60, name
        assert stage(spark, docs.limit(0), d).collect() == [], name
    ids = [r["doc_id"] for r in P.drop_near_copies(spark, docs, d).collect()]
    assert ids.count(5) == 1 and ids.count(None) == 2


def test_held_out_labels_teach_nothing(spark, planted):
    from gustlab.llm.queries import remainder
    from pyspark.sql import functions as F

    ids = [r[0] for r in spark.range(200).where(remainder(F.col("id"), 3) == 1).collect()]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
