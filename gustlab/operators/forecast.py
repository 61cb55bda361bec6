"""Forecasting: lagged-feature models, ARIMA with order search and choice of d, back-tests.

Series positions come from the distributed index; lags are equi-joins/fan-outs on positions; the ARIMA fit
reduces each series to its cross-product sums in one aggregate, and only those small per-series systems and
the h-step recursions run in grouped pandas.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustlab.operators import timeseries as tsx
from gustlab.operators.evaluate import regression_metrics
from gustlab.operators.models import FITTERS
from gustlab.session import cut_lineage


# --------------------------------------------------------------------------------------------- H8
def lag_features(df: DataFrame, cols: Sequence[str], steps: int, order: str = "ts", by: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Sequence windows (E14) flattened to ``{col}_l{j}`` columns, j = 0 (current) .. steps-1."""
    seq = tsx.sequence_windows(df, cols, steps, order, by, out="__seq")
    names, exprs = [], []
    for j in range(steps):
        step = F.try_element_at("__seq", F.lit(-(j + 1)))
        for i, c in enumerate(cols):
            names.append(f"{c}_l{j}")
            exprs.append(F.try_element_at(step, F.lit(i + 1)).alias(f"{c}_l{j}"))
    return seq.select("*", *exprs).drop("__seq"), names


def lagged_forecast(df: DataFrame, target: str, features: Sequence[str], test_start: str, horizon: int = 1,
                    steps: int = 3, train_days: int = 7, val_days: int = 1, test_days: int = 1,
                    model: str = "gbt", ts: str = "ts", scale_on: str = "train", restore: str = "causal",
                    **params) -> DataFrame:
    """Forecast the ``horizon``-step difference of ``target`` from recent feature history, restore the level,
    and return the scored test rows (H8; LSTM re-aimed).

    Steps: difference (E3, wrap as the reference) -> z-score features (T13: ``scale_on`` train, the causal default, or all as the reference) -> sequence
    windows (E14) -> date split with validation day (E13) -> fit (early stopping on validation for ``gbt``)
    -> predict -> undifference (E4, T12: ``restore`` causal/reference).
    """
    d = tsx.difference(df, target, horizon, order=ts, wrap=True, lead_col="__lead", diff_col="__diff")
    d = tsx.temporal_split(d, test_start, train_days, test_days, val_days, horizon, ts=ts, label="__split")
    fit_filter = None if scale_on == "all" else (F.col("__split") == "train")
    d = tsx.zscore(d, list(features), fit_filter=fit_filter, centre_constant=True)
    d, lagged = lag_features(d, list(features), steps, ts)
    d = d.filter(F.col("__split").isNotNull())
    train = d.filter(F.col("__split").isin("train", "validation")).withColumn(
        "__is_val", F.col("__split") == "validation")
    has_val = val_days > 0 and train.filter(F.col("__is_val")).limit(1).count() > 0
    if model == "gbt":
        # a long horizon can leave the validation window empty (val = test - days + horizon): no early stop then
        fm = FITTERS["gbt"](train, lagged, "__diff", validation="__is_val" if has_val else None, **params)
    else:
        fm = FITTERS[model](train.filter(~F.col("__is_val")), lagged, "__diff", **params)
    scored = fm.predict(d.filter(F.col("__split") == "test"), out="__pred")
    out = tsx.undifference(scored, "__pred", target, "__lead", horizon, order=ts, mode=restore,
                           out="predicted")
    return out.select(ts, F.col(target).alias("actual"), "predicted", F.col("__pred").alias("predicted_diff"),
                      F.col("__diff").alias("actual_diff"))


def backtest(df: DataFrame, target: str, features: Sequence[str], horizons: Sequence[int], origins: Sequence[str],
             model: str = "gbt", parallelism: int = 4, **kw) -> DataFrame:
    """Repeat split/fit/score per (horizon, origin) and report metrics per cell (H16); cells run as parallel jobs."""
    from gustlab.operators.models import _run_parallel

    base = df.cache()

    def cell(h, o):
        def task():
            scored = lagged_forecast(base, target, features, o, horizon=h, model=model, **kw)
            return regression_metrics(scored, "actual", "predicted").select(
                F.lit(h).alias("horizon"), F.lit(o).alias("origin"), F.lit(model).alias("model"), "*").collect()
        return task

    rows = _run_parallel([cell(h, o) for h in horizons for o in origins], parallelism)
    schema = ("horizon int, origin string, model string, n long, mae double, rmse double, mape double, "
              "n_zero long, r2 double, r2_corr double, mean_error_pct double")
    return df.sparkSession.createDataFrame([r for rs in rows for r in rs], schema)


def backtest_grid(df: DataFrame, target: str, features: Sequence[str], horizons: Sequence[int], origins: Sequence[str],
                  steps: int = 3, train_days: int = 7, val_days: int = 1, test_days: int = 1, ts: str = "ts", units: int = 64,
                  reg: float = 0.1, seed: int = 123) -> DataFrame:
    """Metrics per (horizon, origin) of random-layer forecasts, all cells from one prepared table.

    The feature windows and the leads of every horizon are built once. One pass sums each cell's Gram blocks over its own
    training rows (dates as :func:`tsx.temporal_split`), one pass scores each cell's test rows, restored causally:
    ``x(t) - d(t)`` against ``x(t + h)``. Features are scaled by the rows before the earliest test row, so no cell
    sees its future. Rows whose lead or window is missing take no part.
    """
    from gustlab.operators.models import _GRAM_SCHEMA, RandomFeatureMap, _sum_arrays, ridge_solve

    horizons, origins = sorted({int(h) for h in horizons}), list(origins)
    starts = [np.datetime64(o.replace(" ", "T"), "us") for o in origins]
    first = min(starts) - np.timedelta64(max(horizons), "h")
    base = df.select(ts, target, *[c for c in features if c not in (ts, target)])
    raw = tsx.zscore(base.withColumn("__x", F.col(target).cast("double")), list(features),
                     F.col(ts) < F.lit(str(first).replace("T", " ")).cast("timestamp_ntz"), centre_constant=True)
    d, lagged = lag_features(raw, list(features), steps, ts)
    ix, nb = tsx._positions(d.select(ts, "__x", *lagged), ts, keep_bucket=True)
    # a lead is a lag in the reversed order
    back = tsx.positioned_lags(ix.withColumn(tsx.IDX, -F.col(tsx.IDX)), nb, [], "__x", horizons, "__lead")
    table = cut_lineage(back.select(ts, "__x", *lagged, *[f"__lead{h}" for h in horizons]).na.drop(subset=["__x", *lagged]))
    fm = RandomFeatureMap.relu(lagged, units, seed)
    cells = [(i, h) for i in range(len(origins)) for h in horizons]
    day, hour = np.timedelta64(1, "D"), np.timedelta64(1, "h")

    def rows_of(pdf, i, h):
        """Training and test rows of a cell."""
        t = pdf[ts].to_numpy().astype("datetime64[us]")
        test = starts[i] - h * hour
        train_end = test - val_days * day + h * hour if val_days else test
        known = pdf[f"__lead{h}"].notna().to_numpy()
        end = test + test_days * day + h * hour
        # no label reaches the first test row, whatever the horizon
        train = known & (t >= test - train_days * day) & (t < train_end) & (t + h * hour < test)
        return train, known & (t >= test) & (t + h * hour <= end)

    def gram(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z, x = fm.design(pdf), pdf["__x"].to_numpy(float)
            for i, h in cells:
                m, _ = rows_of(pdf, i, h)
                if m.any():
                    y = x[m] - pdf[f"__lead{h}"].to_numpy(float)[m]
                    g = acc.setdefault((i, h), [0.0, 0.0, 0])
                    acc[(i, h)] = [g[0] + z[m].T @ z[m], g[1] + z[m].T @ y, g[2] + int(m.sum())]
        if acc:
            yield pd.DataFrame([{"repeat": i, "fold": h, "zz": g[0].ravel().tolist(), "zy": g[1].tolist(), "n": g[2]}
                                for (i, h), g in acc.items()])

    some = table.mapInPandas(gram, _GRAM_SCHEMA).withColumn("__b", F.spark_partition_id() % 64).groupBy(
        "repeat", "fold", "__b").applyInPandas(lambda p: _sum_arrays(p), _GRAM_SCHEMA)
    sums = some.groupBy("repeat", "fold").applyInPandas(lambda p: _sum_arrays(p), _GRAM_SCHEMA).collect()  # a line a cell
    coef = {(r["repeat"], r["fold"]): ridge_solve(np.array(r["zz"]).reshape(units + 1, -1), np.array(r["zy"]), reg) for r in sums}

    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            z, x = fm.design(pdf), pdf["__x"].to_numpy(float)
            for i, h in cells:
                _, m = rows_of(pdf, i, h)
                if m.any() and (i, h) in coef:
                    yield pd.DataFrame({"horizon": h, "origin": origins[i], "actual": pdf[f"__lead{h}"].to_numpy(float)[m],
                                        "predicted": x[m] - z[m] @ coef[(i, h)]})

    scored = table.mapInPandas(score, "horizon int, origin string, actual double, predicted double")
    return regression_metrics(scored, "actual", "predicted", by=["horizon", "origin"])


# --------------------------------------------------------------------------------------------- H9
def positions(df: DataFrame, value: str, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., _pos, _bkt, __x)``: the series numbered once (bucketed index) and cached for the fit passes.

    The bucket count is kept on the frame's ``_nb`` column so later lag steps know whether edges exist.
    """
    by = list(by)
    ix, nb = tsx._positions(df.select(*by, ts, value).filter(F.col(value).isNotNull()), ts, by, keep_bucket=True)
    return ix.select(*by, "_pos", "_bkt", F.col(value).cast("double").alias("__x"), F.lit(nb).alias("_nb")).cache()


SERIES = "__series"


def _keyed(df: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """A single series gets a series column so every step runs the keyed plan. It is derived from the data
    (not a literal), so Catalyst cannot fold join keys on it into a cross join."""
    by = list(by)
    if by:
        return df, by, False
    key = F.coalesce(F.col(value).cast("double") * 0, F.lit(0.0)).cast("int")
    return df.withColumn(SERIES, key), [SERIES], True


def _nb(pos: DataFrame) -> int:
    return int(pos.select("_nb").first()[0]) if "_nb" in pos.columns else 2


def _ar_design(df: DataFrame, value: str, ts: str, by: Sequence[str], max_p: int, d: int) -> DataFrame:
    """``(by..., _pos, _bkt, __y, __l1..__l{max_p})`` with ``__y`` the d-times differenced series (d in 0, 1)."""
    by = list(by)
    pos = df if "__x" in df.columns and "_pos" in df.columns else positions(df, value, ts, by)
    nb = _nb(pos)
    if d == 1:
        y = tsx.positioned_lags(pos, nb, by, "__x", [1], "__xp").select(
            *by, "_pos", "_bkt", (F.col("__x") - F.col("__xp1")).alias("__y"))
    elif d == 0:
        y = pos.select(*by, "_pos", "_bkt", F.col("__x").alias("__y"))
    else:
        raise ValueError("d must be 0 or 1")
    if not max_p:
        return y.na.drop()
    return tsx.positioned_lags(y, nb, by, "__y", list(range(1, max_p + 1)), "__l").na.drop()


def _cross_sums(x: DataFrame, by: list[str], regs: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy")]
    for i, a in enumerate(regs):
        aggs.append(F.sum(F.col(a) * F.col("__y")).alias(f"xy{i}"))
        for j, b in enumerate(regs[i:], start=i):
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"xx{i}_{j}"))
    return x.groupBy(*by).agg(*aggs) if by else x.agg(*aggs)


def _orders_solver(by: list[str], k: int, max_p: int, max_q: int, d: int, fixed: tuple[int, int] | None = None):
    """Per-series solve of every (p, q) sub-block of the cross-product sums; least AICc wins."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = float(r["n"])
            xx = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    xx[i, j] = xx[j, i] = r[f"xx{i}_{j}"]
            xy = np.array([r[f"xy{i}"] for i in range(k)])
            best = None
            orders = [fixed] if fixed else [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
            for p, q in orders:
                idx = [0] + list(range(1, p + 1)) + list(range(max_p + 1, max_p + 1 + q))
                a, bvec = xx[np.ix_(idx, idx)], xy[idx]
                try:
                    beta = np.linalg.solve(a, bvec)
                except np.linalg.LinAlgError:
                    continue
                rss = max(float(r["yy"] - 2 * beta @ bvec + beta @ a @ beta), 1e-300)
                s2 = rss / n
                params = len(idx) + 1
                ll = -0.5 * n * (math.log(2 * math.pi * s2) + 1)
                corr = 2 * params * (params + 1) / (n - params - 1) if n - params - 1 > 0 else math.inf
                aicc = -2 * ll + 2 * params + corr
                if best is None or aicc < best[0]:
                    best = (aicc, p, q, beta, s2)
            out = {c: r[c] for c in by}
            if best is None:
                out.update(p=None, d=d, q=None, intercept=None, coefs=None, ma_coefs=None, sigma2=None, aicc=None,
                           n=int(n))
            else:
                _, p, q, beta, s2 = best
                out.update(p=p, d=d, q=q, intercept=float(beta[0]), coefs=[float(v) for v in beta[1:1 + p]],
                           ma_coefs=[float(v) for v in beta[1 + p:]], sigma2=s2, aicc=best[0], n=int(n))
            rows.append(out)
        return pd.DataFrame(rows, columns=[*by, "p", "d", "q", "intercept", "coefs", "ma_coefs", "sigma2", "aicc", "n"])
    return solve


def _solve_grouped(sums: DataFrame, by: list[str], solver) -> DataFrame:
    key_schema = ", ".join(f"{c} {t}" for c, t in sums.select(*by).dtypes) if by else ""
    schema = (key_schema + ", " if key_schema else "") + (
        "p int, d int, q int, intercept double, coefs array<double>, ma_coefs array<double>, sigma2 double, "
        "aicc double, n long")

    def run(batches):  # many series a batch: a row of sums each
        for pdf in batches:
            if len(pdf):
                yield solver(pdf)

    return sums.mapInPandas(run, schema)


def _lags(base: DataFrame, by: list[str], col: str, prefix: str, k: int, nb: int = 2) -> DataFrame:
    """Values of ``col`` at positions pos-1..pos-k as ``{prefix}1..{prefix}k``."""
    out = tsx.positioned_lags(base.select(*by, "_pos", "_bkt", col), nb, by, col, list(range(1, k + 1)), prefix)
    return out.select(*by, "_pos", *[f"{prefix}{j}" for j in range(1, k + 1)])


def innovations(df: DataFrame, value: str, ts: str, by: Sequence[str], m: int, d: int) -> DataFrame:
    """Innovation estimates: residuals of a long AR(m) fit on the differenced series (Hannan–Rissanen stage 1)."""
    by = list(by)
    x = _ar_design(df, value, ts, by, m, d).withColumn("__one", F.lit(1.0))
    fit = _solve_grouped(_cross_sums(x, by, ["__one"] + [f"__l{j}" for j in range(1, m + 1)]), by,
                         _orders_solver(by, m + 1, m, 0, d, fixed=(m, 0)))
    return arima_residuals(df, value, fit, ts, by)


def arima_fit(df: DataFrame, value: str, ts: str = "ts", by: Sequence[str] = (), max_p: int = 5,
              d: int = 1, max_q: int = 0, long_ar: int | None = None, innov: DataFrame | None = None) -> DataFrame:
    """ARIMA(p, d, q) per series, orders p <= max_p, q <= max_q by least AICc (H9; a simpler search than auto.arima).

    ``q = 0``: AR(p) by least squares on one common sample. ``q > 0``: Hannan–Rissanen — a long AR fit
    estimates the innovations, then ``y`` is regressed on its lags and the innovation lags. Either way, one
    aggregate per series gives all cross-product sums and every order is a sub-block of them.
    Output per series: ``p, d, q, intercept, coefs, ma_coefs, sigma2, aicc, n``.
    """
    by = list(by)
    if not by and "__x" not in df.columns:
        df, by, _ = _keyed(df, value, by)
        return arima_fit(df, value, ts, by, max_p, d, max_q, long_ar, innov).drop(SERIES)
    df = df if "__x" in df.columns else positions(df, value, ts, by)
    if max_q == 0:
        x = _ar_design(df, value, ts, by, max_p, d).withColumn("__one", F.lit(1.0))
        regs = ["__one"] + [f"__l{j}" for j in range(1, max_p + 1)]
        return _solve_grouped(_cross_sums(x, by, regs), by, _orders_solver(by, len(regs), max_p, 0, d))
    m = long_ar or max(8, max_p + max_q)
    resid = (innov if innov is not None else innovations(df, value, ts, by, m, d)).withColumnRenamed("resid", "__e")
    nb = _nb(df)
    y = _ar_design(df, value, ts, by, max_p, d)
    x = y.join(_lags(resid, by, "__e", "__m", max_q, nb), on=[*by, "_pos"]).na.drop().withColumn("__one", F.lit(1.0))
    regs = ["__one"] + [f"__l{j}" for j in range(1, max_p + 1)] + [f"__m{j}" for j in range(1, max_q + 1)]
    return _solve_grouped(_cross_sums(x, by, regs), by, _orders_solver(by, len(regs), max_p, max_q, d))


def arima_forecast(df: DataFrame, value: str, h: int, ts: str = "ts", by: Sequence[str] = (), max_p: int = 5,
                   d: int = 1, max_q: int = 0, long_ar: int | None = None) -> DataFrame:
    """Fit (see :func:`arima_fit`) and forecast ``h`` steps past each series' end: ``(by..., step, forecast)``.

    Future innovations are zero; the last ``q`` ones come from the long-AR stage.
    """
    by = list(by)
    if not by:
        df, by, _ = _keyed(df, value, by)
        return arima_forecast(df, value, h, ts, by, max_p, d, max_q, long_ar).drop(SERIES)
    pos = positions(df, value, ts, by)
    inn = innovations(pos, value, ts, by, long_ar or max(8, max_p + max_q), d).cache() if max_q else None
    fit = arima_fit(pos, value, ts, by, max_p, d, max_q, long_ar, innov=inn)
    if max_q:
        last = inn.groupBy(*by).agg(F.max("_pos").alias("__lp"))
        inn = inn.join(last, on=by)
        inn = inn.filter(F.col("_pos") > F.col("__lp") - max_q).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("_pos", F.col("resid").alias("e")))).alias("__eps"))
        fit = fit.join(inn, on=by, how="left")
    else:
        fit = fit.withColumn("__eps", F.lit(None).cast("array<struct<_pos:long,e:double>>"))
    n = pos.groupBy(*by).agg(F.max("_pos").alias("__last"))
    tail = pos.join(n, on=by)
    tail = tail.filter(F.col("_pos") >= F.col("__last") - (max_p + 1))
    tail = tail.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_pos", F.col("__x").alias("v"))))
                                 .alias("__tail"))
    both = tail.join(fit, on=by)
    out_schema = (", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes) + ", " if by else "") + \
        "step int, forecast double, p int, q int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            vals = [float(s["v"]) for s in r["__tail"]]
            p = int(r["p"]) if r["p"] is not None and not pd.isna(r["p"]) else 0
            coefs = list(r["coefs"]) if r["coefs"] is not None else []
            c = float(r["intercept"]) if r["intercept"] is not None else 0.0
            hist = list(np.diff(vals)) if d == 1 else list(vals)
            level = vals[-1]
            ma = list(r["ma_coefs"]) if r["ma_coefs"] is not None else []
            eps = [float(e["e"]) for e in r["__eps"]] if r["__eps"] is not None else []
            for s in range(1, h + 1):
                yhat = c + sum(coefs[j] * hist[-(j + 1)] for j in range(p) if len(hist) > j)
                yhat += sum(ma[j] * eps[-(j + 1)] for j in range(len(ma)) if len(eps) > j)
                hist.append(yhat)
                eps.append(0.0)
                level = level + yhat if d == 1 else yhat
                row = {k: r[k] for k in by}
                row.update(step=s, forecast=float(level), p=p, q=len(ma))
                rows.append(row)
        return pd.DataFrame(rows, columns=[*by, "step", "forecast", "p", "q"])

    return both.mapInPandas(lambda batches: (run(pdf) for pdf in batches if len(pdf)), out_schema)


def arima_residuals(df: DataFrame, value: str, fit: DataFrame, ts: str = "ts", by: Sequence[str] = (),
                    long_ar: int | None = None) -> DataFrame:
    """One-step residuals of a fitted ARIMA model on its own series: ``(by..., _pos, resid)`` (input to E12).

    All fitted terms count: the AR terms on the differenced series and, with q > 0, the MA terms on the innovation
    estimates that the fit used (``long_ar`` as there). ``d`` is one number for all series of ``fit``.
    """
    by = list(by)
    size = lambda c: F.max(F.size(F.coalesce(F.col(c), F.array().cast("array<double>"))))
    top = fit.agg(size("coefs").alias("p"), size("ma_coefs").alias("q"), F.max("d").alias("d")).first()
    p, q, d = (int(top[c] or 0) for c in ("p", "q", "d"))
    single = not by
    if single:
        # one series: its single fit row is read as literals (a join on a constant key would plan a cross join)
        row = fit.first()
        df, by, _ = _keyed(df, value, by)
    pos = df if "__x" in df.columns else positions(df, value, ts, by)
    x = _ar_design(pos, value, ts, by, p, d)
    if q:
        e = innovations(pos, value, ts, by, long_ar or max(8, p + q), d).withColumnRenamed("resid", "__e")
        x = tsx.null_safe_join(x, _lags(e, by, "__e", "__m", q, _nb(pos)), [*by, "_pos"]).na.drop(
            subset=[f"__m{j}" for j in range(1, q + 1)])
    if single:
        term = lambda c, j: F.lit(float(row[c][j - 1]))
        pred = F.lit(float(row["intercept"] or 0.0))
    else:
        x = tsx.null_safe_join(x, fit.select(*by, "intercept", "coefs", "ma_coefs"), by)
        term = lambda c, j: F.coalesce(F.try_element_at(c, F.lit(j)), F.lit(0.0))
        pred = F.col("intercept")
    for j in range(1, p + 1):
        pred = pred + term("coefs", j) * F.col(f"__l{j}")
    for j in range(1, q + 1):
        pred = pred + term("ma_coefs", j) * F.col(f"__m{j}")
    return x.select(*([] if single else by), "_pos", "_bkt", (F.col("__y") - pred).alias("resid"))


# --------------------------------------------------------------------------------------------- choice of d
KPSS_5 = 0.463  # fixed value: 5 % point of the level statistic


def kpss(df: DataFrame, value: str, ts: str = "ts", by: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """KPSS level statistic per series: ``(by..., n, lags, kpss)``, ``Σ S_t² / (n² s²)`` with ``S_t`` the running sums of the
    centred values and ``s²`` their long-run variance (Bartlett weights over ``lags``).

    ``lags`` defaults to ``trunc(4 (n / 100)^(1/4))`` of the longest series. Running sums are windows inside the position
    ranges plus the ranges' totals. A constant series has NULL.
    """
    by = list(by)
    base = df.select(*by, ts, value).filter(F.col(value).isNotNull())
    ix, nb = tsx._positions(base, ts, by, keep_bucket=True)
    stats = cut_lineage(ix.groupBy(*by).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("n")))
    if lags is None:
        longest = stats.agg(F.max("n")).first()[0] or 0
        lags = int(4 * (longest / 100) ** 0.25)
    c = tsx.attach(ix, stats, by).withColumn("__d", F.col(value) - F.col("__m"))
    total = c.groupBy(*by, "_bkt").agg(F.sum("__d").alias("__t"))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "_bkt", F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__off"))
    inside = Window.partitionBy(*by, "_bkt").orderBy(tsx.IDX).rowsBetween(Window.unboundedPreceding, 0)
    c = tsx.null_safe_join(c, total, [*by, "_bkt"]) if nb > 1 else c.withColumn("__off", F.lit(0.0))
    run = c.withColumn("__s", F.col("__off") + F.sum("__d").over(inside))
    sums = run.groupBy(*by).agg(F.sum(F.col("__s") * F.col("__s")).alias("__ss"), F.sum(F.col("__d") * F.col("__d")).alias("__dd"))
    r = tsx.acf(base, value, max(lags, 1), ts, by).filter((F.col("lag") >= 1) & (F.col("lag") <= lags))
    weight = 1 - F.col("lag") / F.lit(lags + 1.0)
    long_run = r.groupBy(*by).agg((1 + 2 * F.sum(weight * F.col("acf"))).alias("__w"))
    out = tsx.attach(tsx.attach(sums, stats, by), long_run, by)
    s2 = F.col("__dd") / F.col("n") * F.coalesce(F.col("__w"), F.lit(1.0))
    return out.select(*by, "n", F.lit(lags).alias("lags"), F.try_divide(F.col("__ss"), F.col("n") * F.col("n") * s2).alias("kpss"))


def choose_d(df: DataFrame, value: str, ts: str = "ts", by: Sequence[str] = ()) -> int:
    """0 where no series' level is rejected by the KPSS test at 5 %, else 1 (the differences that :func:`arima_fit` takes)."""
    worst = kpss(df, value, ts, by).agg(F.max("kpss")).first()[0]
    return int(worst is not None and worst > KPSS_5)
