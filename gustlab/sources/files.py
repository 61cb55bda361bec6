"""Sources and sinks (A1-A10).

Readers keep every cell as text (no schema inference pass) and tag rows with their file through
``_metadata.file_name``; typing is a separate column-expression step.
"""

from __future__ import annotations

import contextlib
import io
import json
import zipfile
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gustlab.functions.columns import parse_dmy_hm

MONTH_TAG = r"(\d{2}-\d{4})"


# --------------------------------------------------------------------------------------------- A4
def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """File paths matching a glob, through the cluster's file system (names only, no data)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(p) or []
    return sorted(s.getPath().toString() for s in st if s.isFile())


def exclude_files(df: DataFrame, names: Sequence[str], file_col: str = "source_file") -> DataFrame:
    """Drop rows from superseded files (A4)."""
    return df.filter(~F.col(file_col).isin(list(names)))


# --------------------------------------------------------------------------------------------- A5
def file_month_label(file_col: Column, regex: str = MONTH_TAG) -> Column:
    """``.../export_01-2017.csv`` -> ``Jan2017`` (A5)."""
    tag = F.regexp_extract(file_col, regex, 1)
    return F.date_format(F.to_date(F.concat(F.lit("01-"), tag), "dd-MM-yyyy"), "MMMyyyy")


# --------------------------------------------------------------------------------------------- A1
def file_label(path_col: Column, regex: str = MONTH_TAG, as_month: bool = True) -> Column:
    """Label from a file path: ``MM-YYYY`` -> ``MonYYYY`` (A5), or the raw regex capture."""
    return file_month_label(path_col, regex) if as_month else F.regexp_extract(path_col, regex, 1)


def read_scada(spark: SparkSession, path: str, sep: str = ";", trailer_rows: int | dict | None = None,
               ts_col: str | None = None, label_regex: str = MONTH_TAG, label_is_month: bool = True) -> DataFrame:
    """Monthly SCADA exports -> all-text wide frame + ``source_file`` + ``filename`` (month label).

    Default: metadata trailers are dropped by keeping rows whose first column parses as ``dd/MM/yyyy HH:mm``.
    ``trailer_rows`` (int, or per-file dict by base name) instead drops exactly that many last lines per file,
    by line position (see :func:`_read_exact_trailer`).
    """
    if trailer_rows is not None:
        return _read_exact_trailer(spark, path, sep, trailer_rows, label_regex, label_is_month)
    df = (spark.read.option("sep", sep).option("header", True)
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
          .option("mode", "PERMISSIVE").csv(path))
    ts_col = ts_col or df.columns[0]
    src = F.col("_metadata.file_name")
    df = df.select("*", src.alias("source_file"), F.col("_metadata.file_path").alias("__path"))
    return df.filter(parse_dmy_hm(F.col(f"`{ts_col}`")).isNotNull()).withColumn(
        "filename", file_label(F.col("__path"), label_regex, label_is_month)).drop("__path")


def _read_exact_trailer(spark, path, sep, trailer_rows, label_regex=MONTH_TAG, label_is_month=True):
    """Exact trailer removal by line position within each file.

    A line's place in its file is (split start offset, read order inside the split): the file-scan metadata
    and ``monotonically_increasing_id`` give both, and the bucketed position index numbers the lines per file
    without putting a file into one task. Line 0 is the header; the last ``trailer_rows`` lines are dropped.
    """
    from gustlab.operators.timeseries import sequence_index

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").cast("double").alias("__blk"),
        F.monotonically_increasing_id().alias("__mid"), F.col("value").alias("line"))
    pos = sequence_index(lines, "__blk", ["__path"], idx="__pos", tiebreak=["__mid"])
    n = lines.groupBy("__path").agg(F.count(F.lit(1)).alias("__n"))
    if isinstance(trailer_rows, dict):
        m = F.create_map(*[x for kv in trailer_rows.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        drop = F.coalesce(m[F.col("source_file")], F.lit(0))
    else:
        drop = F.lit(int(trailer_rows))
    pos = pos.join(n, on="__path")
    first = pos.filter(F.col("__pos") == 0).select("line").first()
    if first is None:
        raise ValueError(f"no rows in {path}")
    names = [h.strip() for h in first["line"].split(sep)]
    body = pos.filter((F.col("__pos") >= 1) & (F.col("__pos") < F.col("__n") - drop))
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    opts = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = body.select("source_file", "__path", F.from_csv("line", schema, opts).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n_) for i, n_ in enumerate(names)], "source_file",
                         file_label(F.col("__path"), label_regex, label_is_month).alias("filename"))


# --------------------------------------------------------------------------------------------- A2
def read_weather(spark: SparkSession, pattern: str, drop_pattern: str | None = None,
                 drop_cols: Sequence[str] = (), label_regex: str = MONTH_TAG, label_is_month: bool = True) -> DataFrame:
    """Monthly weather CSVs whose headers differ -> one frame, absent columns NULL (A2, F2).

    Files are grouped by header line, one reader per distinct header, then ``unionByName``. The first
    (row id) column is dropped; ``month_label`` comes from the file name (T17).
    """
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=16) as ex:  # header lines only, read through the cluster file system
        headers = list(ex.map(lambda f: _first_line(spark, f), files))
    by_header: dict[str, list[str]] = {}
    for f, h in zip(files, headers):
        by_header.setdefault(h, []).append(f)
    frames = []
    for header, fs in by_header.items():
        d = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
            "ignoreTrailingWhiteSpace", True).csv(fs)
        d = d.drop(d.columns[0]).withColumns({"source_file": F.col("_metadata.file_name"),
                                              "__path": F.col("_metadata.file_path")})
        frames.append(d)
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    if drop_pattern or drop_cols:
        from gustlab.operators.reshape import drop_matching

        out = drop_matching(out, drop_pattern or r"(?!)", drop_cols)
    return out.withColumn("month_label", file_label(F.col("__path"), label_regex, label_is_month)).drop("__path")


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p)))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


# --------------------------------------------------------------------------------------------- A3
LINES_PER_BATCH = 100_000
_LINES = "archive string, member string, line_no long, line string, header long"


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


@contextlib.contextmanager
def _opened(path: str):
    """An archive on any of Arrow's file systems (local, HDFS, S3, GCS)."""
    from pyarrow import fs as pafs

    store, inner = pafs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as handle, zipfile.ZipFile(handle) as zf:
        yield zf


def _members(batches):
    """Names of the members of each archive, from its central directory alone."""
    import pyarrow as pa

    for b in batches:
        for path in b.column(0).to_pylist():
            with _opened(path) as zf:
                names = [m for m in zf.namelist() if not m.endswith("/")]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["archive", "member"])


class _ZipReader(DataSourceReader):
    def __init__(self, members: list[list[str]]):
        self.members = members

    def partitions(self):
        return [_Member(a, m) for a, m in self.members] or [_Member("", "")]

    def read(self, partition):
        """The lines of a member in batches of at most LINES_PER_BATCH."""
        import pyarrow as pa

        if not partition.archive:
            return

        def batch(start, lines, header):
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.archive] * n), pa.array([partition.member] * n), pa.array(range(start, start + n), pa.int64()),
                 pa.array(lines), pa.array([header] * n, pa.int64())], ["archive", "member", "line_no", "line", "header"])

        with _opened(partition.archive) as zf, zf.open(partition.member) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
            lines, start, header = [], 0, None
            for line in text:
                lines.append(line.rstrip("\n"))
                header = zlib.crc32(lines[0].encode()) if header is None else header
                if len(lines) == LINES_PER_BATCH:
                    yield batch(start, lines, header)
                    start, lines = start + len(lines), []
            if lines:
                yield batch(start, lines, header)


class ZipLines(DataSource):
    """Spark data source ``zip_lines``: the text lines of the members of zip archives (option ``members``: a JSON list of
    archive and member)."""

    @classmethod
    def name(cls):
        return "zip_lines"

    def schema(self):
        return _LINES

    def reader(self, schema):
        return _ZipReader(json.loads(self.options["members"]))


def read_zipped_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Zip archives -> one row per text line of every member (A3): archive, member, line_no from 0, line, and ``header``, a
    checksum of the member's first line.

    Spark lists the archives and tasks list their members (names only). Every member is a partition: its task opens the
    archive, goes to the member by the central directory and streams it, so one large archive is the work of many tasks
    and nothing has to fit in memory.
    """
    paths = spark.read.format("binaryFile").load(pattern).select("path")
    names = paths.mapInArrow(_members, "archive string, member string").orderBy("archive", "member").collect()
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").option("members", json.dumps([list(r) for r in names])).load()


def parse_delimited(lines: DataFrame, sep: str = ";", header_line: int = 0) -> DataFrame:
    """Lines of delimited text -> all-text columns by name: a member's first line (``header_line`` 0) names its columns.

    Members may have other columns or another order: the result has the columns of all headers, by their first
    appearance among the headers in the order of archive and member, NULL where a member lacks one. Of equal names in one
    header the first, second, ... belong together. Distinct headers (one a file format) are read by the driver. Lines
    without a ``header`` checksum, and headers on a later line, are taken as of one format, the first member's.
    """
    heads = lines.filter(F.col("line_no") == header_line)
    by_member = "header" in lines.columns and header_line == 0
    if by_member:
        first = heads.groupBy("header", "line").agg(F.min(F.struct("archive", "member")).alias("at")).orderBy("at").collect()
    else:
        first = heads.orderBy("archive", "member").limit(1).collect()
    if not first:
        raise ValueError("no header line")
    formats, order = [], {}
    for r in first:
        seen: dict[str, int] = {}
        columns = {}
        for i, name in enumerate(h.strip() for h in r["line"].split(sep)):
            seen[name] = seen.get(name, 0) + 1
            columns[(name, seen[name])] = i
            order.setdefault((name, seen[name]), len(order))
        formats.append((r["header"] if by_member else None, columns))
    schema = ", ".join(f"c{i} STRING" for i in range(max(len(c) for _, c in formats)))
    opts = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    body = lines.filter(F.col("line_no") != header_line)
    p = body.select("archive", "member", *(["header"] if by_member else []), F.from_csv("line", schema, opts).alias("r"))

    def value(key):
        at = [(h, c[key]) for h, c in formats if key in c]
        if len(at) == len(formats) and len({i for _, i in at}) == 1:
            return F.col(f"r.c{at[0][1]}")
        out = F.lit(None).cast("string")
        for h, i in at:
            out = F.when(F.col("header") == h, F.col(f"r.c{i}")).otherwise(out)
        return out

    return p.select(*[value(k).alias(k[0]) for k in order], F.col("member").alias("source_file"), F.col("archive").alias("source_archive"))


# --------------------------------------------------------------------------------------------- A6, A7
def save_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Persist as Parquet, partitioned so later month filters prune directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> str:
    """Small result table -> one CSV file with a header (A7). Only for report-sized frames."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


# --------------------------------------------------------------------------------------------- A8
# Nominal power curve of the turbine model (fixed values): wind speed 4.0 to 25.0 m/s in 0.5 steps.
CURVE_POWER_KW = [
    75, 170, 275, 380, 527, 827, 1126, 1412, 1698, 1968,
    2237, 2476, 2715, 2911, 3106, 3200, 3285, 3360, 3400, 3400,
    3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400,
    3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400, 3400,
    3400, 3400, 3400,
]
CURVE_WIND_MS = [4.0 + 0.5 * i for i in range(len(CURVE_POWER_KW))]


def power_curve(spark: SparkSession, band: float = 0.2) -> DataFrame:
    """The 43-point curve with its ±20 % band."""
    rows = [(float(w), float(p)) for w, p in zip(CURVE_WIND_MS, CURVE_POWER_KW)]
    df = spark.createDataFrame(rows, "wind_speed double, power double")
    return df.withColumns({"lo20": F.col("power") * (1 - band), "hi20": F.col("power") * (1 + band)})


# --------------------------------------------------------------------------------------------- A9, A10
def param_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Cartesian product of tuning values (A9), built by chained explodes of literal arrays."""
    df = spark.range(1).select()
    for name, vals in values.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in vals])).alias(name))
    return df


def date_sequence(spark: SparkSession, start: str, end: str, step: str = "1 day", col: str = "ts") -> DataFrame:
    """Every step between two timestamps, both ends included (A10)."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"),
                                                      F.lit(end).cast("timestamp_ntz"),
                                                      F.expr(f"INTERVAL {step}"))).alias(col))


def calendar_spine(df: DataFrame, ts: str = "ts", step: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Every slot between each series' first and last timestamp (A10 as the spine for gap finding).

    Bounds come from one aggregate; the slots are generated per series on the executors.
    """
    keys = list(keys)
    b = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    return b.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {step}"))).alias(ts))
