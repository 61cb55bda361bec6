"""Vectorised text helpers shared by the operators of this subpackage.

Texts arrive as Arrow batches inside tasks and are cut into chunks of whole rows of about ``CHUNK_BYTES``, so the
NumPy temporaries stay small whatever the batch holds; one longer text is a chunk of its own. Null texts count as
empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2^64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Scratch(dict):
    """A cache that stays in its process: pickled, it is empty (Spark ships this package's modules by value)."""

    def __reduce__(self):
        return Scratch, ()


_POW = Scratch()

_BYTE_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE_VALUES[_LOWER]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every byte of a non-ASCII character are word bytes.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _POW["p"], _POW["i"] = np.cumprod(up), np.cumprod(down)
    return _POW["p"], _POW["i"]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, one text after the other, and the n + 1 offsets of the texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each (a longer row alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def tokens(data: np.ndarray, offsets: np.ndarray, token_byte: np.ndarray):
    """Starts, ends and row numbers of the maximal runs of ``token_byte`` bytes; runs never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = token_byte[data]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte run, the same wherever the run stands (ASCII case folded on request)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE_VALUES)[data] * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5):
    """Hashes of the runs of ``k`` words of each row, and their row numbers; a shorter row has one of all its words."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    pos = np.arange(len(hashes)) - first[rows]
    length = np.minimum(k, counts)[rows]
    keep = pos + length <= counts[rows]
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    mult = np.uint64(1)
    for j in range(k):
        use = length[at] > j
        if use.all():
            out += hashes[at + j] * mult
        else:
            out[use] += hashes[at[use] + j] * mult
        mult = np.uint64((int(mult) * 0xC2B2AE3D27D4EB4F + 2) & 0xFFFFFFFFFFFFFFFF) | np.uint64(1)
    return mix(out), rows[at]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names clash with ``names`` (letter case aside); an operator's outputs win."""
    low = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in low]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in clash]) if clash else df


def append(df: DataFrame, text: str, keep: list[str] | None, out: str,
           make: Callable[[], Callable[[pa.Array, np.ndarray, np.ndarray], dict]]) -> DataFrame:
    """``keep`` (default: all columns) plus the ``out`` columns (a DDL string), computed chunk by chunk in the tasks.

    ``make()`` runs once a task and gives ``f(texts, bytes, offsets) -> {name: array}`` for a chunk of whole rows. The
    text is read from a private copy, so an input column may be named like an output; it is then replaced.
    """
    new = T.StructType.fromDDL(out)
    kept = without(df, new.names) if keep is None else without(df.select(*[F.col(f"`{c}`") for c in keep]), new.names)
    src = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*kept.schema.fields, *new.fields])
    names = [f.name for f in kept.schema.fields]

    def run(batches):
        f = make()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            _, off = utf8(texts)
            for i, j in row_chunks(off):
                part = texts.slice(i, j - i)
                got = f(part, *utf8(part))
                cols = [b.column(k).slice(i, j - i) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(got[n]) if not isinstance(got[n], pa.Array)
                                                           else got[n] for n in new.names]], [*names, *new.names])

    return src.mapInArrow(run, schema)


def grouped(batches, keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows equal in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        i = 0
        for j in cuts:
            if j > i:
                held.append(b.slice(i, j - i))
            if j < b.num_rows or (j == 0):
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            i = j
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
