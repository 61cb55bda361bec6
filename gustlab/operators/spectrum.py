"""Autocorrelation at every lag of a series by a distributed Fourier transform.

The centred series, padded with zeros to a power of two of at least twice its length, is laid out as a matrix of about as
many rows as columns. A task transforms a bundle of columns, multiplies by the twiddle factors and hands blocks to the
bundles of rows; a task there finishes the transform, takes the power spectrum and begins the inverse; a second
exchange of blocks ends it. So n lags cost two shuffles of the padded series, not n passes, and no task holds
more than ``CELLS`` cells, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.operators.timeseries import IDX, QNORM_975, attach, sequence_index

CELLS = 1 << 20


class Grid:
    """The matrix of a series of ``n`` values: ``rows`` x ``cols`` >= 2 n cells, in bundles of ``wide`` columns or ``high`` rows."""

    def __init__(self, n: int, cells: int = CELLS):
        bits = (2 * n - 1).bit_length()
        self.rows, self.cols = 1 << bits // 2, 1 << bits - bits // 2
        self.wide, self.high = min(self.cols, max(1, cells // self.rows)), min(self.rows, max(1, cells // self.cols))

    def turn(self, k: np.ndarray, j: np.ndarray, sign: int) -> np.ndarray:
        """The twiddle factors; products are reduced as integers, so long series lose no digits."""
        size = self.rows * self.cols
        return np.exp(sign * 2j * np.pi * (np.multiply.outer(k, j) % size) / size)


def _blocks(key, n, den, parts, at, blocks) -> pa.Table:
    m = len(parts)
    keys = [pa.array([k.as_py()] * m, k.type) for k in key[:-1]]
    return pa.Table.from_arrays([*keys, pa.array([n] * m, pa.int64()), pa.array([den] * m, pa.float64()), pa.array(parts, pa.int64()),
                                 pa.array([at] * m, pa.int64()), pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())],
                                names=[*[f"k{i}" for i in range(len(keys))], "n", "den", "part", "at", "block"])


def acf_full(df: DataFrame, col: str, order: str = "ts", by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """Autocorrelation at the lags 0 to n - 1 of each series: ``by..., lag, acf, ci, significant, n`` as :func:`timeseries.acf` has
    them, a row a lag.

    NULL and NaN values are left out before places are counted; a constant series has NULL. A bundle of columns or rows is
    a task's share, of at most ``cells`` cells (or one column, about the root of twice the length).
    """
    by = list(by)
    value = null_if_nan(qcol(col)).cast("double")
    base = df.select(*[qcol(c).alias(f"k{i}") for i, c in enumerate(by)], qcol(order).alias("__o"), value.alias("__x")).filter(
        "__x is not null")
    ks = [f"k{i}" for i in range(len(by))]
    ix = sequence_index(base, "__o", ks)
    stats = ix.groupBy(*ks).agg(F.avg("__x").alias("__m"), F.count(F.lit(1)).alias("n"),
                                (F.var_pop("__x") * F.count(F.lit(1))).alias("den"))
    bits = F.length(F.bin(2 * F.col("n") - 1))
    rows, cols = F.expr("shiftleft(1L, __b div 2)"), F.expr("shiftleft(1L, int(__b - __b div 2))")
    c = attach(ix, stats, ks).withColumn("__b", bits.cast("int"))
    wide = F.least(cols, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(cells) / rows)))
    c = c.select(*ks, "n", "den", F.col(IDX).alias("pos"), (F.col("__x") - F.col("__m")).alias("d"),
                 F.floor((F.col(IDX) % cols) / wide).cast("long").alias("part"))
    types = dict(base.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in ks)
    block = schema + "n long, den double, part long, at long, block binary"

    def columns(key, t):
        n, den, at = t.column("n")[0].as_py(), t.column("den")[0].as_py(), key[-1].as_py()
        g, pos = Grid(n, cells), t.column("pos").to_numpy()
        a = np.zeros((g.rows, g.wide))
        a[pos // g.cols, pos % g.cols - at * g.wide] = t.column("d").to_numpy()
        x = np.fft.fft(a, axis=0) * g.turn(np.arange(g.rows), at * g.wide + np.arange(g.wide), -1)
        parts = range(g.rows // g.high)
        return _blocks(key, n, den, parts, at, [x[p * g.high:(p + 1) * g.high] for p in parts])

    def rows_of(key, t):
        n, den, at = t.column("n")[0].as_py(), t.column("den")[0].as_py(), key[-1].as_py()
        g = Grid(n, cells)
        x = np.zeros((g.high, g.cols), complex)
        for k, b in zip(t.column("at").to_pylist(), t.column("block").to_pylist()):
            x[:, k * g.wide:(k + 1) * g.wide] = np.frombuffer(b, complex).reshape(g.high, g.wide)
        power = np.abs(np.fft.fft(x, axis=1)) ** 2
        y = np.fft.ifft(power, axis=1) * g.turn(at * g.high + np.arange(g.high), np.arange(g.cols), 1)
        parts = range(g.cols // g.wide)
        return _blocks(key, n, den, parts, at, [y[:, p * g.wide:(p + 1) * g.wide] for p in parts])

    def lags(key, t):
        n, den, at = t.column("n")[0].as_py(), t.column("den")[0].as_py(), key[-1].as_py()
        g = Grid(n, cells)
        y = np.zeros((g.rows, g.wide), complex)
        for k, b in zip(t.column("at").to_pylist(), t.column("block").to_pylist()):
            y[k * g.high:(k + 1) * g.high] = np.frombuffer(b, complex).reshape(g.high, g.wide)
        num = np.fft.ifft(y, axis=0).real
        lag = np.add.outer(g.cols * np.arange(g.rows), at * g.wide + np.arange(g.wide))
        keep = lag < n
        m = int(keep.sum())
        keys = [pa.array([k.as_py()] * m, k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*keys, pa.array(lag[keep], pa.int64()), pa.array(num[keep]), pa.array([n] * m, pa.int64()),
                                     pa.array([den] * m, pa.float64())], names=[*ks, "lag", "num", "n", "den"])

    s = c.groupBy(*ks, "part").applyInArrow(columns, block)
    s = s.groupBy(*ks, "part").applyInArrow(rows_of, block)
    r = s.groupBy(*ks, "part").applyInArrow(lags, schema + "lag long, num double, n long, den double")
    ci = F.lit(QNORM_975) / F.sqrt(F.col("n"))
    val = F.try_divide(F.col("num"), F.col("den"))
    return r.select(*[F.col(k).alias(b) for k, b in zip(ks, by)], "lag", val.alias("acf"), ci.alias("ci"),
                    (F.abs(val) > ci).alias("significant"), "n")
