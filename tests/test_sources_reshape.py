"""Small operators: unions, complement, slices, grids, sequences, report sink, zip reader."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from gustlab.operators import reshape as R
from gustlab.sources import files as SRC


def test_unions_and_complement(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    c = spark.createDataFrame([(3,)], "k int")
    assert R.union_all([a, b]).count() == 3
    assert R.union_distinct([a, b]).count() == 2
    u = R.union_all([a, c], allow_missing=True).collect()
    assert {(r["k"], r["s"]) for r in u} == {(1, "x"), (3, None)}
    lab = b.withColumn("split", F.when(F.col("k") == 1, "train").otherwise("test"))
    assert [r["k"] for r in R.complement(lab, "split", "train").collect()] == [2]


def test_row_slice_closed_ends(spark):
    t0 = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h),) for h in range(5)], "ts timestamp_ntz")
    assert R.row_slice(df, "2020-01-01 01:00:00", "2020-01-01 03:00:00").count() == 3
    assert R.row_slice(df, "2020-01-01 01:00:00", "2020-01-01 03:00:00", closed="left").count() == 2


def test_param_grid_and_date_sequence(spark):
    g = SRC.param_grid(spark, sigma=[0.1, 0.2], c=[1, 10, 100])
    assert g.count() == 6 and set(g.columns) == {"sigma", "c"}
    s = SRC.date_sequence(spark, "2017-01-01 00:00:00", "2017-01-31 00:00:00")
    assert s.count() == 31


def test_report_sink_single_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "f string, v double")
    out = SRC.write_report(df, str(tmp_path / "rep"))
    files = [p for p in (tmp_path / "rep").iterdir() if p.name.endswith(".csv")]
    assert len(files) == 1
    assert spark.read.option("header", True).csv(out).count() == 2


def test_zip_reader(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("m1.csv", "timestamp;a\n01/01/2017 00:00;1\n01/01/2017 00:10;2\n")
        zf.writestr("m2.csv", "timestamp;a\n01/02/2017 00:00;3\n")
    (tmp_path / "d.zip").write_bytes(buf.getvalue())
    lines = SRC.read_zipped_lines(spark, str(tmp_path / "*.zip"))
    wide = SRC.parse_delimited(lines, sep=";")
    assert sorted(r["a"] for r in wide.collect()) == ["1", "2", "3"]


def test_calendar_spine_and_exclusion(spark):
    t0 = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("A", t0), ("A", t0 + dt.timedelta(hours=3)), ("B", t0)], "k string, ts timestamp_ntz")
    sp = SRC.calendar_spine(df, keys=["k"])
    assert sp.filter("k = 'A'").count() == 4 and sp.filter("k = 'B'").count() == 1
    f = df.withColumn("source_file", F.lit("old.csv"))
    assert SRC.exclude_files(f, ["old.csv"]).count() == 0


def test_period_arithmetic_assemble_and_rank_join(spark):
    from gustlab.functions import columns as C
    from gustlab.operators import stats as ST

    t0 = dt.datetime(2018, 8, 31)
    df = spark.createDataFrame([(t0, 1.0, 2.0), (t0, 3.0, 2.0)], "ts timestamp_ntz, a double, b double")
    r = df.select(C.add_hours(F.col("ts"), -1).alias("h"), C.add_days(F.col("ts"), 7).alias("d")).first()
    assert r["h"] == dt.datetime(2018, 8, 30, 23) and r["d"] == dt.datetime(2018, 9, 7)
    v = R.assemble(df, ["a", "b"]).select("features").collect()
    assert [list(x[0]) for x in v] == [[1.0, 2.0], [3.0, 2.0]]
    ranked = {row["a"]: row["rank"] for row in ST.with_average_rank(df, "b").collect()}
    assert ranked == {1.0: 1.5, 3.0: 1.5}
    kept = R.drop_matching(df.withColumn("ozone", F.lit(1)), "ozone|precipt", ["b"]).columns
    assert kept == ["ts", "a"]
