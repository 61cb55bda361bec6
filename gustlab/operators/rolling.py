"""Rolling-origin back-tests: every day an origin, every horizon a cell, from prefix sums of Gram blocks.

A day's rows are turned into Gram blocks once, one a horizon and day of the label. A cell (origin, window, horizon) trains on
the labels of the window's days, so its sums are the difference of two prefix sums over days, whatever the window.
Days are grouped in chunks of ``CHUNK`` with the window before them, so no task holds more than a chunk's blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.operators.evaluate import metric_columns
from gustlab.operators.models import RandomFeatureMap, ridge_solve
from gustlab.session import cut_lineage

DAY = 86_400
CHUNK = 128


def _seconds(ts) -> F.Column:
    """Seconds since 1970 by the calendar fields, so the session's zone plays no part."""
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


class _Day:
    """The rows of a day with their lagged inputs, and labels by time, from the rows around the day."""

    def __init__(self, pdf: pd.DataFrame, day: int, k: int, steps: int, step: int, fm: RandomFeatureMap):
        pdf = pdf.sort_values(["t", "x"]).drop_duplicates("t", keep="last")
        self.times, self.x = pdf["t"].to_numpy(), pdf["x"].to_numpy(float)
        own = self.times[self.times // DAY == day]
        f = pdf[[f"f{i}" for i in range(k)]].to_numpy(float)
        lagged = np.column_stack([self._at(f, own - j * step) for j in range(steps)]) if len(own) else np.zeros((0, k * steps))
        level = self._at(self.x, own)
        ok = ~np.isnan(lagged).any(axis=1) & ~np.isnan(level)
        self.t, self.level = own[ok], level[ok]
        self.z = np.column_stack([np.ones(int(ok.sum())), fm.apply(lagged[ok])])

    def _at(self, values: np.ndarray, t: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.times, t), len(self.times) - 1)
        out = values[i].astype(float, copy=True)
        out[self.times[i] != t] = np.nan
        return out

    def labels(self, shift: int) -> np.ndarray:
        return self._at(self.x, self.t + shift)


def _around(df: DataFrame, target: str, features: Sequence[str], by: list[str], ts: str, horizon: int, window: int, steps: int, step: int):
    """Rows of each day and of the hours before and after it that its lags and labels reach (columns k*, t, day, x, f*)."""
    t = _seconds(qcol(ts))
    num = lambda c: null_if_nan(qcol(c).cast("double"))
    base = df.where(qcol(ts).isNotNull()).select(*[qcol(c).alias(f"k{i}") for i, c in enumerate(by)], t.alias("t"), num(target).alias("x"),
                                                 *[num(c).alias(f"f{i}") for i, c in enumerate(features)])
    first = base.agg(F.min("t")).first()[0]
    if first is not None:  # scaled by the days before the first origin, so that no cell sees its future
        cols = range(len(features))
        r = base.where(F.col("t") < (first // DAY + window) * DAY).agg(*[g(f"f{i}") for i in cols for g in (F.avg, F.stddev_samp)]).first()
        base = base.withColumns({f"f{i}": (F.col(f"f{i}") - F.lit(r[2 * i] or 0.0)) / F.lit(r[2 * i + 1] or 1.0) for i in cols})
    days = F.sequence(F.floor((F.col("t") - horizon * step) / DAY), F.floor((F.col("t") + (steps - 1) * step) / DAY))
    return base.withColumn("day", F.explode(days))


def rolling_predictions(df: DataFrame, target: str, features: Sequence[str], horizons: Sequence[int], window: int = 7, steps: int = 3,
                        by: Sequence[str] = (), ts: str = "ts", step: int = 3600, units: int = 64, reg: float = 0.1, seed: int = 123,
                        min_rows: int = 24, chunk: int = CHUNK) -> DataFrame:
    """Forecasts of every cell: ``by..., origin date, horizon int, n_train long, made_at, actual, predicted, persistence``.

    Each day is an origin; it forecasts from its own rows, and learns from rows whose label lies in the ``window`` days before
    it, so no label reaches its first test row. The random-layer model of the last ``steps`` values of ``features`` predicts
    the change of ``target`` over ``horizon`` steps of ``step`` seconds; persistence predicts none. Lags and labels are
    met by time: a gap makes them missing, and the row takes no part in that cell. Of rows of one series and
    time the largest target stays. Cells with fewer than ``min_rows`` training rows are left out. NULL and NaN are missing.
    """
    by, horizons, features = list(by), sorted({int(h) for h in horizons}), list(features)
    fm = RandomFeatureMap.relu([f"l{i}" for i in range(len(features) * steps)], units, seed)
    k, size = len(features), units + 1
    rows = cut_lineage(_around(df, target, features, by, ts, max(horizons), window, steps, step))
    ks = [f"k{i}" for i in range(len(by))]
    types = dict(rows.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in ks)

    def gram(key, pdf):
        d = _Day(pdf, int(key[-1]), k, steps, step, fm)
        out = []
        for h in horizons:
            label = d.labels(h * step)
            when = (d.t + h * step) // DAY
            for day in np.unique(when):
                m = (when == day) & ~np.isnan(label)
                if m.any():
                    z = d.z[m]
                    out.append((*key[:-1], h, int(day), (z.T @ z).tobytes(), (z.T @ (d.level[m] - label[m])).tobytes(), int(m.sum())))
        return pd.DataFrame(out, columns=[*ks, "h", "day", "zz", "zy", "n"])

    def fit(key, pdf):
        first = int(key[-1]) * chunk
        lo, hi = int(pdf["day"].min()), max(int(pdf["day"].max()), first + chunk - 1)
        zz, zy, n = np.zeros((hi - lo + 2, size, size)), np.zeros((hi - lo + 2, size)), np.zeros(hi - lo + 2, np.int64)
        for day, a, b, c in zip(pdf["day"], pdf["zz"], pdf["zy"], pdf["n"]):
            i = int(day) - lo + 1
            zz[i] += np.frombuffer(a).reshape(size, size)
            zy[i] += np.frombuffer(b)
            n[i] += c
        zz, zy, n = zz.cumsum(axis=0), zy.cumsum(axis=0), n.cumsum()
        out = []
        for origin in range(max(first, lo + 1), first + chunk):
            i, j = origin - lo, max(origin - window - lo, 0)
            if n[i] - n[j] >= min_rows:
                coef = ridge_solve(zz[i] - zz[j], zy[i] - zy[j], reg)
                out.append((*key[:-2], int(key[-2]), origin, int(n[i] - n[j]), coef.tobytes()))
        return pd.DataFrame(out, columns=[*ks, "h", "day", "n_train", "coef"])

    def score(key, pdf, coefs):
        if pdf.empty or coefs.empty:
            return pd.DataFrame([], columns=[*ks, "day", "h", "n_train", "t", "actual", "predicted", "persistence"])
        d = _Day(pdf, int(key[-1]), k, steps, step, fm)
        out = []
        for h, n, c in zip(coefs["h"], coefs["n_train"], coefs["coef"]):
            label = d.labels(int(h) * step)
            m = ~np.isnan(label)
            guess = d.level[m] - d.z[m] @ np.frombuffer(c)
            out += [(*key, int(h), int(n), int(t), a, p, x) for t, a, p, x in zip(d.t[m], label[m], guess, d.level[m])]
        return pd.DataFrame(out, columns=[*ks, "day", "h", "n_train", "t", "actual", "predicted", "persistence"])

    blocks = rows.groupBy(*ks, "day").applyInPandas(gram, head + "h int, day long, zz binary, zy binary, n long")
    # a block serves the origins of the next ``window`` days
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("day") + 1) / chunk), F.floor((F.col("day") + window) / chunk))))
    coefs = dealt.groupBy(*ks, "h", "chunk").applyInPandas(fit, head + "h int, day long, n_train long, coef binary")
    out = rows.groupBy(*ks, "day").cogroup(coefs.groupBy(*ks, "day")).applyInPandas(
        score, head + "day long, h int, n_train long, t long, actual double, predicted double, persistence double")
    made = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("t"))
    return out.select(*[F.col(c).alias(b) for c, b in zip(ks, by)], F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("origin"),
                      F.col("h").alias("horizon"), "n_train", made.alias("made_at"), "actual", "predicted", "persistence")


def rolling_backtest(df: DataFrame, target: str, features: Sequence[str], horizons: Sequence[int], by: Sequence[str] = (), **kw) -> DataFrame:
    """Metrics per (series, origin, horizon) of :func:`rolling_predictions`, with persistence's beside the model's."""
    got = rolling_predictions(df, target, features, horizons, by=by, **kw)
    err = F.col("persistence") - F.col("actual")
    return got.groupBy(*by, "origin", "horizon").agg(
        F.first("n_train").alias("n_train"), *metric_columns(F.col("actual"), F.col("predicted")),
        F.avg(F.abs(err)).alias("mae_persistence"), F.sqrt(F.avg(err * err)).alias("rmse_persistence"))
