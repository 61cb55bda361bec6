"""Kernel regression that gross errors cannot pull away: Huber loss on Nyström features (H6).

A bounded set of landmark rows spans the kernel; a row's features are its kernel values to the landmarks, whitened by the
landmarks' own kernel matrix. The loss is met by reweighting: each pass sums a weighted Gram matrix over all rows in the
tasks, and the new coefficients lower the objective or end the fit. Nothing but the sums (landmarks squared) leaves the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import all_present, qcol
from gustlab.operators.models import FittedModel
from gustlab.session import cut_lineage

TUNING = 1.345  # fixed value: 95 % efficiency under normal errors
MAD = 1.4826  # fixed value: median absolute deviation to standard deviation


@dataclass
class NystromMap:
    """Kernel features ``exp(-sigma |x - l|²)`` to the landmarks, whitened; the interface of the random maps."""

    inputs: list[str]
    landmarks: np.ndarray
    sigma: float
    white: np.ndarray = field(init=False)

    def __post_init__(self):
        values, vectors = np.linalg.eigh(self._kernel(self.landmarks))
        keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.white = vectors[:, keep] / np.sqrt(values[keep])

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (self.landmarks ** 2).sum(axis=1)[None] - 2 * x @ self.landmarks.T
        return np.exp(-self.sigma * np.maximum(d, 0.0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x) @ self.white


@dataclass
class RobustFit(FittedModel):
    """A fitted map model with the scale its loss turns linear at, and the objective after each pass."""

    delta: float = 0.0
    objective: list[float] = field(default_factory=list)


def landmark_rows(df: DataFrame, features: Sequence[str], keys: Sequence[str], count: int, seed: int) -> np.ndarray:
    """``count`` distinct rows of inputs, those of the smallest hashes of their keys (a documented bound, no share of the rows)."""
    h = F.xxhash64(*[qcol(k) for k in keys], F.lit(seed))
    cols = [qcol(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    got = df.select(h.alias("h"), *cols).groupBy(*[f"f{i}" for i in range(len(cols))]).agg(F.min("h").alias("h")).orderBy(
        "h", *[f"f{i}" for i in range(len(cols))]).limit(count).collect()
    return np.array([[float(v) for v in r[:-1]] for r in got]).reshape(len(got), len(cols))


def _sums(rows: DataFrame, fm: NystromMap, coef: np.ndarray | None, delta: float | None):
    """Weighted Gram sums, the loss at ``coef`` and the number of rows; weights are 1 without a coefficient or a scale."""
    k = fm.white.shape[1] + 1
    schema = "zz binary, zy binary, loss double, n long"

    def add(pdf):
        return pd.DataFrame([{"zz": sum(np.frombuffer(b) for b in pdf["zz"]).tobytes(), "zy": sum(np.frombuffer(b) for b in pdf["zy"]).tobytes(),
                              "loss": float(pdf["loss"].sum()), "n": int(pdf["n"].sum())}])

    def run(batches):
        zz, zy, loss, n = np.zeros((k, k)), np.zeros(k), 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = pdf[[c for c in pdf.columns if c != "y"]].to_numpy(float), pdf["y"].to_numpy(float)
            z = np.column_stack([np.ones(len(x)), fm.apply(x)])
            w = np.ones(len(y))
            if coef is not None:
                r = np.abs(y - z @ coef)
                if delta is None:
                    loss += float((r * r).sum() / 2)
                else:
                    w = np.minimum(1.0, delta / np.maximum(r, 1e-300))
                    loss += float(np.where(r <= delta, r * r / 2, delta * (r - delta / 2)).sum())
            zz += (z * w[:, None]).T @ z
            zy += z.T @ (w * y)
            n += len(y)
        if n:
            yield pd.DataFrame([{"zz": zz.tobytes(), "zy": zy.tobytes(), "loss": loss, "n": n}])

    parts = rows.mapInPandas(run, schema)
    buckets = max(1, math.isqrt(max(1, rows.rdd.getNumPartitions())))
    got = parts.withColumn("b", F.spark_partition_id() % F.lit(buckets)).groupBy("b").applyInPandas(lambda p: add(p), schema).collect()
    zz = sum((np.frombuffer(r["zz"]).reshape(k, k) for r in got), np.zeros((k, k)))
    return zz, sum((np.frombuffer(r["zy"]) for r in got), np.zeros(k)), sum(r["loss"] for r in got), sum(r["n"] for r in got)


def _solve(zz, zy, c: float) -> np.ndarray:
    ridge = np.eye(len(zz)) / c
    ridge[0, 0] = 0.0
    return np.linalg.lstsq(zz + ridge, zy, rcond=None)[0]


def _scale(rows: DataFrame, fm: NystromMap, coef: np.ndarray) -> float:
    """The errors' standard deviation by their median size."""
    @F.pandas_udf("double")
    def size(*cols: pd.Series) -> pd.Series:
        v = np.column_stack([s.to_numpy(float) for s in cols])
        return pd.Series(np.abs(v[:, -1] - np.column_stack([np.ones(len(v)), fm.apply(v[:, :-1])]) @ coef))

    r = rows.select(size(*rows.columns).alias("r")).agg(F.percentile_approx("r", 0.5, 10_000)).first()[0]
    return MAD * float(r or 0.0)


def fit_robust_kernel(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], sigma: float = 0.2, c: float = 10.0,
                      landmarks: int = 200, delta: float | None = None, passes: int = 50, tolerance: float = 1e-7,
                      seed: int = 123, robust: bool = True) -> RobustFit:
    """Kernel regression under ``c`` times the Huber loss plus half the squared norm (``robust=False``: squared loss).

    The loss turns linear at ``delta``; by default at ``TUNING`` standard deviations of the errors, measured by their median
    through a few passes and then held. ``objective`` lists the value after every pass at the held scale: it never rises.
    Rows with a NULL input or label take no part. ``landmarks`` bounds the rows that span the kernel; all rows are learned.
    """
    features = list(features)
    whole = train.where(all_present([*features, label]))
    rows = cut_lineage(whole.select(*[qcol(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], qcol(label).cast("double").alias("y")))
    marks = landmark_rows(whole, features, keys, landmarks, seed)
    if not len(marks):
        raise ValueError("no row to learn from")
    fm = NystromMap(features, marks, sigma)
    zz, zy, _, _ = _sums(rows, fm, None, None)
    coef = _solve(zz, zy, c)
    fit = RobustFit("robust" if robust else "kernel", None, fm, features, coef)
    if not robust:
        return fit
    if delta is None:
        for _ in range(8):  # a fit less pulled away has a smaller scale, until it settles
            new = TUNING * _scale(rows, fm, coef)
            if new <= 0 or (delta is not None and abs(new - delta) <= 0.02 * delta):
                break
            delta = new
            for _ in range(3):
                zz, zy, _, _ = _sums(rows, fm, coef, delta)
                coef = _solve(zz, zy, c)
        if not delta:
            return fit  # half of the errors are 0
    norm = lambda b: float((b[1:] ** 2).sum() / 2)
    zz, zy, loss, _ = _sums(rows, fm, coef, delta)
    fit.delta, fit.objective = float(delta), [c * loss + norm(coef)]
    for _ in range(passes):
        new = _solve(zz, zy, c)
        zz, zy, loss, _ = _sums(rows, fm, new, delta)
        value = c * loss + norm(new)
        if value > fit.objective[-1]:
            break  # nothing left but rounding
        coef = new
        fit.objective.append(value)
        if fit.objective[-2] - value <= tolerance * abs(value):
            break
    fit.coef = coef
    return fit
