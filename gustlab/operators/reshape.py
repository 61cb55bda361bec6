"""Projections, filters and reshaping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import any_null, col_name, parse_number, qcol

# The 67 per-turbine SCADA measures in export order, as the reference names them (fixed values).
SCADA_NAMES = [
    "blade.angle", "curr.axis1.A", "curr.axis2.A", "curr.axis3.A", "hub.temp.C", "temp.motor.a1.C",
    "temp.motor.a2.C", "temp.motor.a3.C", "temp.base.box.C", "temp.transf.cell.C", "power.cable.util",
    "gen.speed.conv.RPM", "conv.torque.Nm", "pos.act.work.kWh", "neg.act.work.kWh", "pos.react.work.kvarh",
    "neg.react.work.kvarh", "status.power.curve", "tower.oscil.y.mG", "tower.oscil.x.mG",
    "drive.train.osc.z.mG", "active.power.kW", "reactive.power.kvar", "apparent.power.kVa", "cos.phi",
    "setpoint.torque.Nm", "metalscan.particl", "grid.operation.time.s", "cpu.temp", "temp.gearb.bear.3.C",
    "temp.gearb.bear.4.C", "temp.trafo.L2.660V.C", "temp.trafo.L2.950V.C", "temp.transf.iron.core.C",
    "temp.gen.bearing1.C", "Temp.gen.bearing2.C", "temp.stator.wind.C", "gearbox.speed.RPM",
    "actual.volt.L1.N.V", "actual.volt.L2.N.V", "actual.volt.L3.N.V", "actual.curr.I1.A", "actual.curr.I2.A",
    "actual.curr.I3.A", "temp.gearb.bear1.C", "temp.gearb.bear2.C", "temp.gearb.inlet.C",
    "temp.gearb.oil.sump.C", "press.gearb.inlet.BAR", "nacelle.position", "nacelle.temp.C", "wind.speed1.MS",
    "wind.speed2.MS", "wind.speed.MS", "abs.wind.dir", "vane.position", "outd.temp.nacelle.C", "grid.freq.Hz",
    "grid.volt.V", "actual.p.setpoint.kW", "light.redux", "temp.top.box.C", "rotor.speed.RPM",
    "temp.rotor.bearing.C", "curr.A", "wind.speed.ice.det.MS", "torque.Nm",
]
# Spark-friendly names: dots need backticks, so the library uses the snake-case form.
SCADA_COLUMNS = [col_name(n) for n in SCADA_NAMES]


def turbine_labels(n: int) -> list[str]:
    return [f"WT{i + 1:02d}" for i in range(n)]


def turbines_to_long(wide: DataFrame, ts: str, names: Sequence[str], n_turbines: int | None = None,
                     labels: Sequence[str] | None = None, keep: Sequence[str] = (),
                     turbine: str = "turbine") -> DataFrame:
    """Wide export (``ts`` + n blocks of ``len(names)`` columns, in order) -> one row per turbine (B1, B2).

    One scan: each row becomes an array of per-turbine structs, exploded with ``inline``; the positional
    rename happens inside the structs.
    """
    data_cols = [c for c in wide.columns if c != ts and c not in keep]
    per = len(names)
    n = n_turbines or len(data_cols) // per
    if len(data_cols) < n * per:
        raise ValueError(f"expected {n}x{per} measure columns, got {len(data_cols)}")
    labels = list(labels or turbine_labels(n))
    structs = []
    for i in range(n):
        block = data_cols[i * per:(i + 1) * per]
        structs.append(F.struct(F.lit(labels[i]).alias(turbine),
                                *[qcol(c).alias(nm) for c, nm in zip(block, names)]))
    return wide.select(*[qcol(k) for k in keep], qcol(ts).alias(ts), F.inline(F.array(*structs)))


def cast_numeric(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Text columns -> double, dropping ``,`` thousands marks; bad cells -> NULL."""
    cols = cols if cols is not None else [c for c, t in df.dtypes if t == "string" and c not in exclude]
    return df.withColumns({c: parse_number(qcol(c)) for c in cols})


def drop_all_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns without any value (B4): one aggregate, the column list to the driver."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(qcol(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    empty = [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]
    return df.drop(*empty)


def drop_matching(df: DataFrame, pattern: str, also: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose name matches ``pattern`` (case-insensitive) and the ``also`` names."""
    rx = re.compile(pattern, re.IGNORECASE)
    return df.drop(*[c for c in df.columns if rx.search(c)], *[c for c in also if c in df.columns])


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """NULL -> constant."""
    return df.withColumns({c: F.coalesce(qcol(c), F.lit(value)) for c in cols})


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with no NULL (B10, R ``complete.cases``)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one NULL."""
    return df.filter(any_null(cols or df.columns))


def any_of(col: Column, patterns: Sequence[str]) -> Column:
    """Row predicate: text contains any of the patterns (B6; the evident intent of T8)."""
    return col.rlike("|".join(re.escape(p) for p in patterns))


def pick_groups(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Rows of the chosen groups, e.g. one month per season."""
    return df.filter(F.col(col).isin(list(values)))


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "var",
                 val: str = "val") -> DataFrame:
    """Wide -> ``(ids..., var, val)``."""
    return df.unpivot(list(ids), list(values), var, val)


def row_slice(df: DataFrame, start: str, end: str, ts: str = "ts", closed: str = "both") -> DataFrame:
    """Rows between two timestamps (B17); ``closed`` in both/left/right/neither."""
    c = F.col(ts)
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    left = c >= lo if closed in ("both", "left") else c > lo
    right = c <= hi if closed in ("both", "right") else c < hi
    return df.filter(left & right)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Columns -> ML vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Stack frames by column name; differing columns become NULL with ``allow_missing`` (F1, F2)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Combined unique rows."""
    return union_all(frames).distinct()


def complement(df: DataFrame, label: str, value: str) -> DataFrame:
    """Rows not carrying a split label."""
    return df.filter(F.col(label).isNull() | (F.col(label) != value))
