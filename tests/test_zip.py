"""Zip archives: a member a partition, headers by member."""

import zipfile

import pytest

from gustlab.sources import files as SRC


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)


def test_a_member_a_task(spark, tmp_path):
    archive(tmp_path / "one.zip", [("dir/", "")] + [(f"dir/m{i:02d}.csv", f"a;b\n{i};x\n{i + 100};y\n") for i in range(24)])
    lines = SRC.read_zipped_lines(spark, f"{tmp_path}/*.zip")
    assert lines.rdd.getNumPartitions() == 24
    per_task = lines.rdd.mapPartitions(lambda rows: [len({r["member"] for r in rows})]).collect()
    assert per_task == [1] * 24
    got = SRC.parse_delimited(lines).select("a", "b", "source_file").collect()
    assert sorted((int(r["a"]), r["b"], r["source_file"]) for r in got) == sorted(
        (v, b, f"dir/m{i:02d}.csv") for i in range(24) for v, b in ((i, "x"), (i + 100, "y")))


def test_other_headers_land_by_name(spark, tmp_path):
    archive(tmp_path / "a.zip", [("1.csv", "t;x;y\n1;2;3\n"), ("2.csv", "y;t\n30;10\n\n"), ("3.csv", "t;z;x;x\n5;6;7;8\n")])
    archive(tmp_path / "b.zip", [("empty.csv", ""), ("only_header.csv", "t;q\n"), ("1.csv", "t;x;y\n100;200\n")])
    df = SRC.parse_delimited(SRC.read_zipped_lines(spark, f"{tmp_path}/*.zip"))
    assert df.columns == ["t", "x", "y", "z", "x", "q", "source_file", "source_archive"]
    got = sorted([tuple(r)[:7] for r in df.where("t is not null").collect()], key=str)
    assert got == sorted([("1", "2", "3", None, None, None, "1.csv"), ("10", None, "30", None, None, None, "2.csv"),
                          ("5", "7", None, "6", "8", None, "3.csv"), ("100", "200", None, None, None, None, "1.csv")], key=str)


def test_long_member_in_batches(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a.zip", [("long.csv", "n\n" + "".join(f"{i}\n" for i in range(250_000)))])
    df = SRC.parse_delimited(SRC.read_zipped_lines(spark, f"{tmp_path}/a.zip"))
    assert df.selectExpr("count(*) n", "sum(cast(n as long)) s").first() == (250_000, 250_000 * 249_999 // 2)


def test_lines_without_checksums_and_none(spark, tmp_path):
    lines = spark.createDataFrame([("a", "m", 0, "x;y"), ("a", "m", 1, "1;2")], "archive string, member string, line_no long, line string")
    assert [r["y"] for r in SRC.parse_delimited(lines).collect()] == ["2"]
    with pytest.raises(ValueError):
        SRC.parse_delimited(lines.limit(0))
