"""Importance of each input by a local regression of the label on it alone, for models without importances of their own.

An input's range is cut at quantiles; at every cut a quadratic is fitted to the nearest ``span`` of the rows by tricube weights.
Its sums over all rows come from one pass for all inputs and cuts; between two cuts their values and slopes are blended
by the cubic that meets both. The share of the label's variance that this curve explains is the importance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.session import cut_lineage

ACCURACY = 100_000  # of the quantiles: a rank is met within one in so many rows


def cuts(span: float, cell: float = 0.2) -> int:
    """Cells of an input's range: halved until none holds more than ``span * cell`` of the rows."""
    return 1 << max(0, math.ceil(math.log2(1 / (span * cell))))


def blend(x: np.ndarray, at: np.ndarray, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The piecewise cubic with the given values and slopes at the (rising) cuts."""
    if len(at) == 1:
        return np.full(len(x), value[0])
    i = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
    w = at[i + 1] - at[i]
    t = (x - at[i]) / w
    return ((1 + 2 * t) * (1 - t) ** 2 * value[i] + t * (1 - t) ** 2 * w * slope[i]
            + t * t * (3 - 2 * t) * value[i + 1] + t * t * (t - 1) * w * slope[i + 1])


def _tricube(x: np.ndarray, v: float, h: float) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs((x - v) / h) ** 3) ** 3


def _vertex(s: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Value and slope of the weighted quadratic from its moments: ``s`` of powers 0 to 4, ``t`` with the label, 0 to 2."""
    a = np.array([[s[i + j] for j in range(3)] for i in range(3)])
    b = np.linalg.lstsq(a, t, rcond=1e-10)[0]
    return float(b[0]), float(b[1])


def local_curves(df: DataFrame, features: Sequence[str], label: str, span: float = 0.75) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts, values and slopes of each input's local regression (a few numbers an input); an input without rows is left out."""
    features = list(features)
    num = lambda c: null_if_nan(qcol(c).cast("double"))
    rows = cut_lineage(df.select(*[num(c).alias(f"f{i}") for i, c in enumerate(features)], num(label).alias("y")).where("y is not null"))
    return _curves(rows, features, span)


def _curves(rows: DataFrame, features: list[str], span: float):
    k = cuts(span)
    probs = [j / k for j in range(k + 1)]
    got = rows.agg(*[F.percentile_approx(f"f{i}", probs, ACCURACY).alias(f"q{i}") for i in range(len(features))]).first()
    at = {i: np.unique(np.array(got[i], float)) for i in range(len(features)) if got[i] is not None}
    if not at:
        return {}
    near = rows.agg(*[F.percentile_approx(F.abs(F.col(f"f{i}") - F.lit(float(v))), span, ACCURACY).alias(f"h{i}_{j}")
                      for i, vs in at.items() for j, v in enumerate(vs)]).first()
    reach = {(i, j): max(float(near[f"h{i}_{j}"]), 1e-300) for i, vs in at.items() for j in range(len(vs))}
    pairs = sorted(reach)

    def run(batches):
        sums = np.zeros((len(pairs), 8))
        for pdf in batches:
            y = pdf["y"].to_numpy(float)
            for p, (i, j) in enumerate(pairs):
                x = pdf[f"f{i}"].to_numpy(float)
                ok = ~np.isnan(x)
                h, v = reach[i, j], at[i][j]
                u, w, z = (x[ok] - v) / h, _tricube(x[ok], v, h * (1 + 1e-9)), y[ok]
                sums[p] += [*[(w * u ** e).sum() for e in range(5)], *[(w * z * u ** e).sum() for e in range(3)]]
        yield pd.DataFrame({"p": range(len(pairs)), **{f"s{e}": sums[:, e] for e in range(8)}})

    parts = rows.mapInPandas(run, "p int, " + ", ".join(f"s{e} double" for e in range(8)))
    total = {r["p"]: [r[f"s{e}"] for e in range(8)] for r in parts.groupBy("p").agg(*[F.sum(f"s{e}").alias(f"s{e}") for e in range(8)]).collect()}
    out = {}
    for i, vs in at.items():
        fits = []
        for j in range(len(vs)):
            s = np.array(total[pairs.index((i, j))])
            value, slope = _vertex(s[:5], s[5:])
            fits.append((value, slope / reach[i, j]))
        out[features[i]] = (vs, np.array([f[0] for f in fits]), np.array([f[1] for f in fits]))
    return out


def local_importance(df: DataFrame, features: Sequence[str], label: str, span: float = 0.75) -> DataFrame:
    """``feature``, ``importance`` (share of the label's variance that the input's local regression explains, at least 0; NULL
    for an input without values or a label that does not vary), ``n`` rows with both.

    Rows with a NULL or NaN label take no part, those with a NULL or NaN input not for that input. Quantiles are exact on
    tables of up to ``ACCURACY`` rows; the curve's cuts are quantiles, so ties draw cuts together.
    """
    features = list(features)
    num = lambda c: null_if_nan(qcol(c).cast("double"))
    rows = cut_lineage(df.select(*[num(c).alias(f"f{i}") for i, c in enumerate(features)], num(label).alias("y")).where("y is not null"))
    curves = _curves(rows, features, span)

    def run(batches):
        err = np.zeros(len(features))
        for pdf in batches:
            y = pdf["y"].to_numpy(float)
            for i, c in enumerate(features):
                x = pdf[f"f{i}"].to_numpy(float)
                ok = ~np.isnan(x)
                if c in curves and ok.any():
                    err[i] += ((y[ok] - blend(x[ok], *curves[c])) ** 2).sum()
        yield pd.DataFrame({"i": range(len(features)), "sse": err})

    sse = rows.mapInPandas(run, "i int, sse double").groupBy("i").agg(F.sum("sse").alias("sse"))
    there = [F.when(F.col(f"f{i}").isNotNull(), F.col("y")) for i in range(len(features))]
    spread = rows.agg(*[e for i, y in enumerate(there) for e in (F.count(y).alias(f"n{i}"), F.var_pop(y).alias(f"v{i}"))])
    spread = spread.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
                                                        F.col(f"v{i}").alias("v")) for i, c in enumerate(features)])).alias("s")).select("s.*")
    return spread.join(sse, "i", "left").select(
        "feature", F.when((F.col("n") > 0) & (F.col("v") > 0), F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n")))).alias("importance"), "n")
