"""Recurrent forecasts by an echo-state reservoir (H8).

Fixed random recurrent weights turn the inputs' history into a state; only the linear readout is learned. The state is
carried along the series range by range of places: a range's task starts ``washout`` rows before it from a zero state,
whose trace has died away by the range's first row (the weights contract by ``radius`` a step). Readout sums are
Gram matrices added up in the tasks; a second walk scores the test rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.operators import timeseries as tsx
from gustlab.operators.models import ridge_solve
from gustlab.session import cut_lineage


@dataclass
class Reservoir:
    """Weights drawn from a seed: ``units`` states, the recurrent matrix scaled to a spectral norm of ``radius`` (below 1: two
    states that see the same inputs draw together by at least that factor a step)."""

    inputs: int
    units: int = 100
    radius: float = 0.95
    input_scale: float = 0.5
    seed: int = 123

    def __post_init__(self):
        g = np.random.default_rng(self.seed)
        w = g.normal(size=(self.units, self.units))
        self.recurrent = w * (self.radius / np.linalg.norm(w, 2))
        self.inward = g.uniform(-self.input_scale, self.input_scale, size=(self.units, self.inputs + 1))

    def states(self, u: np.ndarray) -> np.ndarray:
        """The state after each input row, from a zero state."""
        drive = u @ self.inward[:, 1:].T + self.inward[:, 0]
        out, s = np.empty((len(u), self.units)), np.zeros(self.units)
        for t in range(len(u)):
            s = out[t] = np.tanh(self.recurrent @ s + drive[t])
        return out


def reservoir_forecast(df: DataFrame, target: str, features: Sequence[str], test_start: str, horizon: int = 1, ts: str = "ts",
                       by: Sequence[str] = (), units: int = 100, radius: float = 0.95, washout: int = 400, reg: float = 1e-4,
                       seed: int = 123, input_scale: float = 0.5, rows_a_range: int = 100_000) -> DataFrame:
    """Forecasts of ``target`` ``horizon`` rows ahead, made at the rows from ``test_start`` on: ``by..., made_at, ts (of the
    forecast value), actual, predicted``.

    The readout (intercept, inputs, states; one for all series) learns the change of the target from the rows whose label
    lies before ``test_start``, the first ``washout`` rows of each series left out. Inputs are scaled by the rows before
    ``test_start``; a NULL or NaN input counts as its mean, a row without a target is no label and no test row. Places are
    counted within a series; equal times come by target.
    """
    by, features, k = list(by), list(features), len(features)
    net = Reservoir(k, units, radius, input_scale, seed)
    num = lambda c: null_if_nan(qcol(c).cast("double"))
    ks = [f"k{i}" for i in range(len(by))]
    base = df.where(qcol(ts).isNotNull()).select(*[qcol(c).alias(a) for c, a in zip(by, ks)], qcol(ts).cast("timestamp_ntz").alias("t"),
                                                 num(target).alias("x"), *[num(c).alias(f"f{i}") for i, c in enumerate(features)])
    start = F.lit(test_start).cast("timestamp_ntz")
    r = base.where(F.col("t") < start).agg(*[g(f"f{i}") for i in range(k) for g in (F.avg, F.stddev_samp)], F.count("*")).first()
    base = base.withColumns({f"f{i}": F.coalesce((F.col(f"f{i}") - F.lit(r[2 * i] or 0.0)) / F.lit(r[2 * i + 1] or 1.0), F.lit(0.0))
                             for i in range(k)}).withColumn("late", F.col("t") >= start)
    ix = tsx.sequence_index(base, "t", ks, tiebreak=["x"])
    # a row serves its own range, the next ones' washout and the label of the one before
    reach = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(tsx.IDX) - horizon) / rows_a_range)),
                       F.floor((F.col(tsx.IDX) + washout) / rows_a_range))
    rows = cut_lineage(ix.withColumn("part", F.explode(reach)))
    size = 1 + k + units

    def walk(key, pdf):
        """Own rows of a range: design, level, label, whether the row and its label are late, times."""
        pdf = pdf.sort_values(tsx.IDX)
        pos, x, late = pdf[tsx.IDX].to_numpy(), pdf["x"].to_numpy(float), pdf["late"].to_numpy(bool)
        u = pdf[[f"f{i}" for i in range(k)]].to_numpy(float)
        own = np.flatnonzero(pos // rows_a_range == int(key[-1]))
        if not len(own):
            return None
        z = np.column_stack([np.ones(len(own)), u[own], net.states(u[:own[-1] + 1])[own]])
        ahead = own + horizon
        there = ahead < len(pos)
        ahead = np.minimum(ahead, len(pos) - 1)
        label = np.where(there, x[ahead], np.nan)
        return z, x[own], label, late[own], late[ahead], pos[own], pdf["t"].to_numpy()[own], pdf["t"].to_numpy()[ahead]

    def gram(key, pdf):
        got = walk(key, pdf)
        if got is not None:
            z, x, y, _, late, pos, _, _ = got
            m = ~late & (pos >= washout) & ~np.isnan(x) & ~np.isnan(y)
            if m.any():
                return pd.DataFrame([{"zz": (z[m].T @ z[m]).tobytes(), "zy": (z[m].T @ (x[m] - y[m])).tobytes()}])
        return pd.DataFrame([], columns=["zz", "zy"])

    def add(pdf):
        return pd.DataFrame([{c: sum(np.frombuffer(b) for b in pdf[c]).tobytes() for c in ("zz", "zy")}])

    schema = "zz binary, zy binary"
    parts = rows.groupBy(*ks, "part").applyInPandas(gram, schema).withColumn("b", F.spark_partition_id() % 64)
    sums = parts.groupBy("b").applyInPandas(lambda p: add(p[["zz", "zy"]]), schema).collect()  # a matrix a bucket
    if not sums:
        coef = np.zeros(size)  # nothing to learn from: persistence
    else:
        coef = ridge_solve(sum(np.frombuffer(s["zz"]).reshape(size, size) for s in sums), sum(np.frombuffer(s["zy"]) for s in sums), reg)

    def score(key, pdf):
        got = walk(key, pdf)
        cols = [*ks, "made_at", "ts", "actual", "predicted"]
        if got is None:
            return pd.DataFrame([], columns=cols)
        z, x, y, late, _, _, at, to = got
        m = late & ~np.isnan(x) & ~np.isnan(y)
        out = pd.DataFrame({"made_at": at[m], "ts": to[m], "actual": y[m], "predicted": x[m] - z[m] @ coef})
        for i, c in enumerate(ks):
            out.insert(i, c, key[i])
        return out[cols]

    types = dict(rows.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in ks)
    got = rows.groupBy(*ks, "part").applyInPandas(score, head + "made_at timestamp_ntz, ts timestamp_ntz, actual double, predicted double")
    return got.select(*[F.col(c).alias(a) for c, a in zip(ks, by)], "made_at", "ts", "actual", "predicted")
