"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of ``DIM`` entries of +1 and -1, drawn from its code point. A letter n-gram
(three symbols; a run of non-letters counts as one boundary symbol) is the element-wise product of its letters'
vectors, each rotated by its place; a text is the sum of its n-grams' vectors. A language's prototype is the sum over
all its training texts, and a text gets the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.session import small_batches

DIM = 1024
MAX_LANGUAGES = 5_000
COUNTS = 1 << 18  # dense counts at a time


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The +1/-1 vectors [n, DIM] of code points (0: the boundary), the same in every process."""
    seed = codes.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03)
    bits = B.mix(seed + (np.arange(DIM // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _is_letter(cps: np.ndarray) -> np.ndarray:
    """Which code points are letters, by Unicode's general categories."""
    seen = np.flatnonzero(np.bincount(cps, minlength=1)).astype(np.uint32)
    table = np.zeros(int(seen[-1]) + 1, bool)
    table[seen] = [chr(c).isalpha() for c in seen.tolist()]
    return table[cps]


def ngrams(data: np.ndarray, offsets: np.ndarray):
    """For a chunk of lower-cased UTF-8 texts: row of each n-gram, its number, the distinct n-grams (code points,
    [n, 3]), and whether each row has a letter."""
    n = len(offsets) - 1
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80  # one lead byte a code point
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    row = np.repeat(np.arange(n), np.diff(at))
    is_letter = _is_letter(cps) if len(cps) else np.zeros(0, bool)
    has = np.zeros(n, bool)
    has[row[is_letter]] = True
    # one boundary before every run of letters and one after: keep letters and the first non-letter after a letter
    keep = is_letter.copy()
    if len(cps):
        keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
        sym = np.where(is_letter, cps, 0)
        # a row opens and closes with a boundary
        pos = np.flatnonzero(keep)
        sym, row = sym[pos], row[pos]
        if len(sym):
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            ends = np.append(starts[1:], len(row))
            closing = ends[sym[ends - 1] != 0]
            where = np.concatenate([starts, closing])
            rows_at = np.concatenate([row[starts], row[closing - 1]])
            # a closing mark of one row comes before the opening mark of the next at the same place
            tie = np.concatenate([np.ones(len(starts), np.int8), np.zeros(len(closing), np.int8)])
            order = np.lexsort((tie, where))
            sym, row = np.insert(sym, where[order], 0), np.insert(row, where[order], rows_at[order])
    else:
        sym, row = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64), has
    alphabet = np.flatnonzero(np.bincount(sym, minlength=1))
    small = np.zeros(int(alphabet[-1]) + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    s, a = small[sym], len(alphabet)
    same = row[2:] == row[:-2]
    code = ((s[:-2] * a + s[1:-1]) * a + s[2:])[same]
    if a ** 3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        number = np.zeros(a ** 3, np.int64)
        number[seen] = np.arange(len(seen))
        inv = number[code]
    else:
        seen, inv = np.unique(code, return_inverse=True)
    grams = np.stack([alphabet[seen // (a * a)], alphabet[seen // a % a], alphabet[seen % a]], 1)
    return row[2:][same], inv, grams, has


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors [n, DIM] of n-grams given as code points."""
    if not len(grams):
        return np.zeros((0, DIM), np.float32)
    codes, inv = np.unique(grams, return_inverse=True)
    base = letter_vectors(codes)
    inv = inv.reshape(grams.shape)
    twice, once = np.roll(base, 2, 1), np.roll(base, 1, 1)
    v = np.empty((len(grams), DIM), np.float32)
    for i in range(0, len(v), 512):
        a = inv[i:i + 512]
        v[i:i + 512] = twice[a[:, 0]] * once[a[:, 1]] * base[a[:, 2]]
    return v


def bundles(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray | None = None, size: int = 0):
    """Bundled vectors [rows or groups, DIM] and whether each row has a letter."""
    row, inv, grams, has = ngrams(data, offsets)
    n = len(offsets) - 1 if groups is None else size
    if not len(grams):
        return np.zeros((n, DIM), np.float32), has
    to = row if groups is None else groups[row]
    if groups is not None:
        ok = to >= 0
        to, inv = to[ok], inv[ok]
    v, out = gram_vectors(grams), np.empty((n, DIM), np.float32)
    step = max(1, min(512, COUNTS // len(v)))
    for i in range(0, n, step):  # blocks of rows, so the dense counts stay small
        j = min(n, i + step)
        if groups is None:
            a, b = np.searchsorted(to, [i, j])
            counts = np.bincount((to[a:b] - i) * len(v) + inv[a:b], minlength=(j - i) * len(v))
        else:
            m = (to >= i) & (to < j)
            counts = np.bincount((to[m] - i) * len(v) + inv[m], minlength=(j - i) * len(v))
        out[i:j] = counts.reshape(j - i, len(v)).astype(np.float32) @ v
    return out, has


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, bundled over all rows with a text and a language.

    Tasks add up their rows' vectors by language; sums meet in two steps (64 groups a language, then one), each of
    vectors of ``DIM`` numbers. The driver gets a vector a language (an error beyond ``MAX_LANGUAGES``).
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(lang).cast("string").alias("lang"), F.lower(F.col(text)).alias("t")).where(
        "lang is not null and t is not null")

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(1), b.column(0).to_pandas()
            _, off = B.utf8(texts)
            for i, j in B.row_chunks(off):
                g, names = pd.factorize(langs.iloc[i:j])
                v, _ = bundles(*B.utf8(texts.slice(i, j - i)), groups=g, size=len(names))
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + v[k].astype(np.float64)
            if len(sums) > 500:
                yield flat(sums)
                sums = {}
        if sums:
            yield flat(sums)

    def flat(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                          ["lang", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, np.float64) for x in pdf["v"])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "v": [v.tobytes()]})

    part = src.mapInArrow(partial, "lang string, v binary").withColumn("salt", F.spark_partition_id() % 64)
    some = part.groupBy("lang", "salt").applyInPandas(lambda p: add(p), "lang string, v binary")
    rows = some.groupBy("lang").applyInPandas(lambda p: add(p), "lang string, v binary").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.frombuffer(r["v"], np.float64)
        if np.linalg.norm(v) > 0:
            out[r["lang"]] = v / np.linalg.norm(v)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus ``lang_pred`` string and ``score`` double.

    ``score`` is the cosine with the chosen prototype, at least 0. A null text, a text without a letter and any text
    where nothing was learned gives ``und`` and 0. Ties go to the first language by code point. Input columns named
    like the outputs are replaced.
    """
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(
        np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32))
    labels = np.array([*names, "und"], object)

    def make():
        P = shared.value

        def f(_, data, off):
            n = len(off) - 1
            best, score = np.full(n, len(names)), np.zeros(n)
            if len(P):
                v, has = bundles(data, off)
                norm = np.linalg.norm(v, axis=1)
                ok = has & (norm > 0)
                cos = (v[ok] @ P.T) / norm[ok][:, None]
                best[ok] = cos.argmax(1)
                score[ok] = np.clip(cos.max(1), 0, 1)
            return {"lang_pred": labels[best], "score": score}
        return f

    low = docs.withColumn("__lower", F.lower(F.col(f"`{text}`")))
    return B.append(low, "__lower", [c for c in docs.columns if keep is None or c in keep],
                    "lang_pred string, score double", make)
