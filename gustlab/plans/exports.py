"""Stand-in export files written from the driver tables, in the layouts the readers expect.

SCADA: one ``;`` file per day in a folder a week label, ``timestamp`` as ``dd/MM/yyyy HH:mm`` then one block of measures per
turbine, power with ``,`` thousands marks, metadata lines at the end. Weather: comma files per week label,
a row-id first column, and one group of weeks without the pressure column (headers differ by file).
Files go to a fresh folder under the shared checkpoint folder.
"""

from __future__ import annotations

import os
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustlab.plans import standins as S
from gustlab.session import scratch_path

TRAILER_LINES = 5
WEEK_DIR = r"filename=(Wk\d\d)"


def scada_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scada_10min pivoted to the export's wide layout (all text)."""
    long = S.scada_10min(spark, sf_dir)
    cols = []
    for t in S.TURBINES:
        for f in S.SCADA_FEATURES:
            v = F.max(F.when(F.col("turbine") == t, F.col(f)))
            cols.append(v.alias(f"{t}_{f}"))
    wide = long.groupBy("filename", "ts").agg(*cols)
    out = [F.date_format("ts", "dd/MM/yyyy HH:mm").alias("timestamp")]
    for t in S.TURBINES:
        for f in S.SCADA_FEATURES:
            c = F.col(f"{t}_{f}")
            # power exported in W/10 with thousands marks, as text
            out.append((F.format_number(c * 10, 3) if f == "active_power_kw" else c.cast("string")).alias(f"{t}_{f}"))
    return wide.select("filename", F.date_format("ts", "yyyyMMdd").alias("day"), F.lit(0).alias("__trailer"), F.col("ts").alias("__ts"), *out)


def write_scada_exports(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "scada-exports")
    data = scada_wide(spark, sf_dir)
    meta_cols = [c for c in data.columns if c not in ("filename", "day", "__trailer", "__ts", "timestamp")]
    trailer = (data.select("filename", "day").distinct()
               .select("filename", "day", F.explode(F.sequence(F.lit(1), F.lit(TRAILER_LINES))).alias("__i"))
               .select("filename", "day", F.lit(1).alias("__trailer"), F.lit(None).cast("timestamp_ntz").alias("__ts"),
                       F.concat(F.lit("Export metadata line "), F.col("__i").cast("string")).alias("timestamp"),
                       *[F.lit(None).cast("string").alias(c) for c in meta_cols]))
    both = data.unionByName(trailer)
    # a file a day, so a week's export is many tasks' work; every file has its own trailer
    (both.repartition("filename", "day").sortWithinPartitions("filename", "day", "__trailer", "__ts")
     .drop("__trailer", "__ts")
     .write.mode("overwrite").partitionBy("filename", "day").option("sep", ";").option("header", True).csv(root))
    return root


def _zip_files(out_root: str):
    def run(batches):
        import io

        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(out_root)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            paths = []
            for path, content in zip(pdf["path"], pdf["content"]):
                label = path.split("filename=")[1].split("/")[0]
                target = f"{root}/scada_{label}_{zlib.crc32(path.encode()):08x}.zip"
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as zf:
                    zf.writestr(os.path.basename(path), content)
                with store.open_output_stream(target, compression=None) as out:
                    out.write(packed.getvalue())
                paths.append(target)
            yield pd.DataFrame({"zip": paths})
    return run


def write_scada_zips(spark: SparkSession, csv_root: str) -> str:
    """Pack every export file into its own zip archive (on the executors)."""
    root = scratch_path(spark, "scada-zips")
    bins = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", True).load(csv_root)
    bins.select("path", "content").mapInPandas(_zip_files(root), T.StructType([T.StructField("zip", T.StringType())])).collect()
    return root


def weather_export_sql() -> str:
    return f"""
    SELECT 'Wk' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS month_label, ts, precip_intensity,
           precip_probability, temperature, apparent_temperature, dew_point, humidity,
           CASE WHEN weekofyear(ts) % 2 = 0 THEN NULL ELSE pressure END AS pressure,
           wind_speed, wind_gust, wind_bearing, visibility
    FROM ({S.WEATHER_HOURLY_SQL})
    """


def write_weather_exports(spark: SparkSession, sf_dir: str) -> str:
    """Weather per week label; even weeks lack the pressure column."""
    root = scratch_path(spark, "weather-exports")
    w = S.weather_hourly(spark, sf_dir)
    wk = F.weekofyear("ts")
    w = w.select(F.date_format("ts", "ddHH").alias("id"),
                 F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
                 *[F.col(c) for c in S.WEATHER_FEATURES],
                 # columns the reader drops by pattern and by name, as the export carries them
                 (F.col("humidity") * 100 + 250).alias("ozone"),
                 F.when(F.col("precip_probability") > 0.2, "Rain").otherwise("Clear").alias("summary"),
                 F.concat(F.lit("Wk"), F.lpad(wk.cast("string"), 2, "0")).alias("filename"), wk.alias("__wk"))
    full = w.filter(F.col("__wk") % 2 == 1).drop("__wk")
    nopress = w.filter(F.col("__wk") % 2 == 0).drop("__wk", "pressure")
    for name, part in (("full", full), ("nopress", nopress)):
        part.write.mode("overwrite").partitionBy("filename").option("header", True).csv(f"{root}/{name}")
    return root
