"""Filling missing values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustlab.functions.columns import add_years, all_present, any_null, qcol
from gustlab.operators.stats import exact_quantiles
from gustlab.session import cut_lineage


# --------------------------------------------------------------------------------------------- D9, B9
def median_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact median per column ignoring NULL (R ``median(na.rm=TRUE)``), averaging the two middle values.

    Values are counted and the counts cumulated (:func:`exact_quantiles`), so ties are one row and no column is ever
    sorted inside one task.
    """
    by = list(by)
    long = df.select(*by, *[qcol(c).cast("double").alias(c) for c in cols]).unpivot(by, list(cols), "__var", "__val")
    q = exact_quantiles(long, "__val", [0.5], [*by, "__var"])
    return q.select(*by, "__var", F.col("q").alias("median"))


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> the column's exact median (D9); the medians (one per column) come to the driver as literals."""
    med = {r["__var"]: r["median"] for r in median_values(df, cols).collect()}
    return df.withColumns({c: F.coalesce(qcol(c), F.lit(med.get(c))) for c in cols})


# --------------------------------------------------------------------------------------------- C2
def impute_from_donor(df: DataFrame, donor: DataFrame, keys: Sequence[str], features: Sequence[str],
                      ts: str = "ts", donor_years: int = 1, mode: str = "row", tag_col: str | None = "filename",
                      tag: str = "_imputed", drop_incomplete: bool = True) -> DataFrame:
    """Fill incomplete rows from the same key and calendar slot of another year.

    ``donor_years`` is added to the donor's timestamps to land on the target's slot. ``mode="row"`` takes the
    donor's whole row (the reference's positional rename), ``"cell"`` fills only NULL cells. Rows still
    incomplete are dropped; the tag column gets ``tag`` appended. The donor is first cut to the slots that
    need it (semi join) and de-duplicated, so the join never multiplies rows.
    """
    keys = list(keys)
    inc = df.filter(any_null(features))
    ok = df.filter(all_present(features))
    d = donor.select(*keys, add_years(F.col(ts), donor_years).alias(ts), *features)
    if mode == "row":
        d = d.filter(all_present(features))  # an incomplete donor row cannot complete anything
    d = d.join(inc.select(*keys, ts), on=[*keys, ts], how="left_semi")
    # Year shifts can map two donor days onto one (29 Feb, 28 Feb): keep the smallest row, deterministically.
    d = d.groupBy(*keys, ts).agg(F.min(F.struct(*[qcol(c) for c in features])).alias("__d"))
    j = inc.join(d, on=[*keys, ts], how="left")
    if mode == "row":
        filled = j.withColumns({c: F.col(f"__d.{c}") for c in features})
    elif mode == "cell":
        filled = j.withColumns({c: F.coalesce(qcol(c), F.col(f"__d.{c}")) for c in features})
    else:
        raise ValueError(mode)
    out = ok.unionByName(filled.drop("__d"))
    if drop_incomplete:
        out = out.filter(all_present(features))
    if tag_col:
        out = out.withColumn(tag_col, F.concat(F.col(tag_col), F.lit(tag)))
    return out


# --------------------------------------------------------------------------------------------- C3, C4
def missing_periods(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), ts: str = "ts",
                    years: int = 1) -> DataFrame:
    """Slots of ``a`` shifted by ``years`` that ``b`` lacks (C3): an anti join on the shifted timestamp."""
    keys = list(keys)
    shifted = a.select(*keys, add_years(F.col(ts), years).alias(ts)).distinct()
    return shifted.join(b.select(*keys, ts), on=[*keys, ts], how="left_anti")


def backfill_missing_periods(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), ts: str = "ts",
                             years: int = 1, relabel: dict | None = None) -> DataFrame:
    """Append to ``b`` the rows of ``a`` whose shifted slot ``b`` lacks, re-stamped into ``b``'s year (C4)."""
    keys = list(keys)
    moved = a.withColumn(ts, add_years(F.col(ts), years))
    moved = moved.join(b.select(*keys, ts), on=[*keys, ts], how="left_anti")
    if relabel:
        moved = moved.withColumns({k: F.lit(v) for k, v in relabel.items()})
    return b.unionByName(moved, allowMissingColumns=True)


# --------------------------------------------------------------------------------------------- C5
def patch_from_year(df: DataFrame, cols: Sequence[str], ts: str = "ts", years: Sequence[int] = (1, -1),
                    drop_incomplete: bool = True) -> DataFrame:
    """Where ``cols`` are NULL, take them from the row ``±years`` away (first offset that has them).

    Only the incomplete rows are joined, against the complete rows' ``(ts, cols)``.
    """
    need = df.filter(any_null(cols))
    src = df.filter(all_present(cols)).select(ts, *cols)
    out = need
    for i, y in enumerate(years):
        cand = src.select(add_years(F.col(ts), -y).alias(ts), F.struct(*cols).alias("__s"))
        cand = cand.join(need.select(ts), on=ts, how="left_semi")
        cand = cand.groupBy(ts).agg(F.min("__s").alias(f"__p{i}"))  # 28/29 Feb collide: deterministic pick
        out = out.join(cand, on=ts, how="left")
    out = out.withColumns({c: F.coalesce(qcol(c), *[F.col(f"__p{i}.{c}") for i in range(len(years))])
                           for c in cols}).drop(*[f"__p{i}" for i in range(len(years))])
    res = df.filter(all_present(cols)).unionByName(out)
    return res.filter(all_present(cols)) if drop_incomplete else res


# --------------------------------------------------------------------------------------------- H2
def fit_line(df: DataFrame, y: str, x: str) -> tuple[float, float]:
    """Least-squares ``y = a + b x`` on rows with both values: one aggregate."""
    r = df.agg(F.regr_intercept(qcol(y), qcol(x)).alias("a"), F.regr_slope(qcol(y), qcol(x)).alias("b")).first()
    return r["a"], r["b"]


def impute_by_regression(df: DataFrame, y: str, x: str, digits: int = 2, train: DataFrame | None = None,
                         pred_col: str | None = None) -> DataFrame:
    """Fit ``y ~ x`` (on ``train`` or all complete rows), fill NULL ``y`` with the rounded prediction (H2)."""
    a, b = fit_line(train if train is not None else df, y, x)
    pred = F.bround(F.lit(a) + F.lit(b) * qcol(x), digits)
    out = df.withColumn(y, F.when(qcol(y).isNull(), pred).otherwise(qcol(y)))
    return out.withColumn(pred_col, pred) if pred_col else out


# --------------------------------------------------------------------------------------------- H3
KNN_PIVOTS, KNN_BLOCK = 256, 4096


def _block_topk(train: pd.DataFrame, queries: pd.DataFrame, k: int, repeats: int) -> pd.DataFrame:
    """The ``k`` nearest training rows of each query in one block pair, per repeat; rows of the query's own fold of a
    repeat are left out (no folds: one repeat, nothing left out)."""
    frames = []
    X = np.stack(train["__x"].to_numpy()).astype(float)
    tk, ty = train["__tk"].to_numpy(np.int64), train["__y"].to_numpy(float)
    tf = np.stack(train["__folds"].to_numpy()).astype(int).reshape(len(tk), -1)
    sq = (X * X).sum(axis=1)
    for lo in range(0, len(queries), 256):  # small steps keep the distance matrix small
        part = queries.iloc[lo:lo + 256]
        Q = np.stack(part["__x"].to_numpy()).astype(float)
        qk = part["__qk"].to_numpy(np.int64)
        qf = np.stack(part["__folds"].to_numpy()).astype(int).reshape(len(qk), -1)
        # screened with the expanded form, re-ranked on exact squared distances
        approx = (Q * Q).sum(axis=1)[:, None] + sq[None, :] - 2.0 * Q @ X.T
        rows = np.arange(len(qk))[:, None]
        for r in range(max(1, repeats)):
            d = np.where(qf[:, r][:, None] == tf[:, r][None, :], np.inf, approx) if repeats else approx
            m = min(len(tk), k + 8)
            sel = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(tk) else np.tile(np.arange(len(tk)), (len(qk), 1))
            diff = Q[:, None, :] - X[sel]
            exact = np.where(np.isinf(d[rows, sel]), np.inf, np.einsum("qmf,qmf->qm", diff, diff))
            order = np.lexsort((tk[sel], exact), axis=1)[:, :k]
            best, at = exact[rows, order], sel[rows, order]
            ok = np.isfinite(best).ravel()
            frames.append(pd.DataFrame({"__qk": np.repeat(qk, best.shape[1])[ok], "__r": r, "__d": best.ravel()[ok],
                                        "__tk": tk[at].ravel()[ok], "__y": ty[at].ravel()[ok]}))
    return pd.concat(frames, ignore_index=True)


_TOP_SCHEMA = "__qk long, __r int, __d double, __tk long, __y double"


def _nearest(train: DataFrame, queries: DataFrame, k: int, repeats: int = 0, pivots: int = KNN_PIVOTS,
             block: int = KNN_BLOCK) -> DataFrame:
    """``(__qk, __r, __d, __tk, __y, __rank)``: the exact ``k`` nearest training rows of every query.

    Training rows ``(__tk, __x, __y, __folds)`` go to the cell of their nearest pivot (at most ``pivots`` of them, the
    first rows by a hash). A query first meets its own cell, which bounds its k-th distance, then only the cells
    that the triangle inequality cannot rule out: ``d(q, pivot) - radius <= k-th distance``. Cells and the queries
    that meet them are dealt to blocks of about ``block`` rows, so each task holds one block pair; only pivots and one
    line a cell reach the driver.
    """
    spark = train.sparkSession
    train = cut_lineage(train)
    queries = cut_lineage(queries)
    n = train.count()
    count = max(1, min(pivots, math.ceil(n / block)))
    rows = train.select("__tk", "__x").orderBy(F.xxhash64("__tk"), "__tk").limit(count).collect()
    if not rows:
        return spark.createDataFrame([], _TOP_SCHEMA + ", __rank int")
    centers = spark.sparkContext.broadcast(np.stack([np.array(r["__x"], float) for r in rows]))

    def distances(pdf):
        X = np.stack(pdf["__x"].to_numpy()).astype(float)
        return np.sqrt(((X[:, None, :] - centers.value[None, :, :]) ** 2).sum(axis=2)) if len(X) * len(centers.value) <= 1 << 20 else \
            np.sqrt(np.maximum(0, (X * X).sum(1)[:, None] + (centers.value ** 2).sum(1)[None, :] - 2 * X @ centers.value.T))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = distances(pdf)
                cell = d.argmin(axis=1)
                yield pdf.assign(__cell=cell.astype(np.int32), __far=d[np.arange(len(pdf)), cell])

    placed = cut_lineage(train.mapInPandas(place, _with(train, "__cell int, __far double")))
    cells = {r["__cell"]: (r["n"], r["far"]) for r in placed.groupBy("__cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("__far").alias("far")).collect()}  # a line a pivot
    radius = np.full(len(rows), -np.inf)
    for c, (_, far) in cells.items():
        radius[c] = far
    slices = {c: math.ceil(m / block) for c, (m, _) in cells.items()}
    sliced = placed.withColumn("__slice", F.pmod(F.xxhash64("__tk", F.lit(1)), _lookup(F.col("__cell"), slices))).drop("__far")

    def meet(asked: DataFrame) -> DataFrame:
        """Top-k of ``asked`` (queries with ``__cell``) within that cell."""
        asked = cut_lineage(asked)
        load = {r["__cell"]: math.ceil(r["n"] / block) for r in asked.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not load:
            return spark.createDataFrame([], _TOP_SCHEMA)
        q = (asked.withColumn("__qb", F.pmod(F.xxhash64("__qk", F.lit(2)), _lookup(F.col("__cell"), load)))
             .withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), _lookup(F.col("__cell"), slices) - 1))))
        t = (sliced.filter(F.col("__cell").isin(list(load)))
             .withColumn("__qb", F.explode(F.sequence(F.lit(0).cast("long"), _lookup(F.col("__cell"), load) - 1))))
        keys = ["__cell", "__slice", "__qb"]

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"__qk": [], "__r": [], "__d": [], "__tk": [], "__y": []})
            return _block_topk(right, left, k, repeats)

        return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(lambda a, b: pair(a, b), _TOP_SCHEMA)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("__qk", "__r").orderBy("__d", "__tk")
        return found.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)

    own = cut_lineage(queries.mapInPandas(place, _with(queries, "__cell int, __far double")))
    first = cut_lineage(best(meet(own.drop("__far"))))
    # a query is settled where every repeat has k neighbours; its bound is the largest of their k-th distances
    bound = (first.groupBy("__qk", "__r").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("d"))
             .groupBy("__qk").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("r"), F.max("d").alias("d")))
    full = (F.col("n") >= k) & (F.col("r") >= max(1, repeats))
    asked = own.join(bound.select("__qk", F.when(full, F.sqrt("d")).alias("__tau")), on="__qk", how="left")

    def others(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            tau = pdf["__tau"].fillna(np.inf).to_numpy(float)
            near = distances(pdf) - radius[None, :] <= tau[:, None] * (1 + 1e-9) + 1e-9
            near[:, np.isneginf(radius)] = False
            near[np.arange(len(pdf)), pdf["__cell"].to_numpy()] = False
            i, c = np.nonzero(near)
            yield from _asking(pdf.drop(columns=["__tau", "__far"]), i, c, block)

    more = asked.mapInPandas(others, _with(queries, "__cell int"))
    return best(first.drop("__rank").unionByName(meet(more)))


def _asking(queries: pd.DataFrame, i: np.ndarray, cells: np.ndarray, step: int):
    """Query ``i[n]`` with ``cells[n]`` as its ``__cell``, ``step`` rows at a time (a query may ask every cell)."""
    for lo in range(0, len(i), step):
        yield queries.iloc[i[lo:lo + step]].assign(__cell=cells[lo:lo + step].astype(np.int32))


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def _lookup(cell: Column, table: dict[int, int]) -> Column:
    """A per-cell number as a long; 1 for cells without one."""
    m = F.create_map(*[x for c, v in table.items() for x in (F.lit(int(c)), F.lit(int(v)))])
    return F.coalesce(m[cell], F.lit(1)).cast("long")


def knn_predict(train: DataFrame, queries: DataFrame, key: str, features: str, target: str, k: int = 5,
                pivots: int = KNN_PIVOTS, block: int = KNN_BLOCK) -> DataFrame:
    """Exact k-nearest-neighbour mean of ``target`` for every query row (Euclidean on an array column).

    Both sides stay on the executors (:func:`_nearest`); ties are broken by the training key. Keys must be unique.
    """
    none = F.array(F.lit(0))
    tr = train.select(F.col(key).cast("long").alias("__tk"), F.col(features).cast("array<double>").alias("__x"),
                      F.col(target).cast("double").alias("__y"), none.alias("__folds"))
    qs = queries.select(F.col(key).cast("long").alias("__qk"), F.col(features).cast("array<double>").alias("__x"), none.alias("__folds"))
    top = _nearest(tr, qs, k, pivots=pivots, block=block)
    return top.groupBy(F.col("__qk").alias(key)).agg(F.avg("__y").alias("prediction"), F.count(F.lit(1)).alias("n_neighbours"))


def impute_by_knn(df: DataFrame, key: str, features: str, target: str, k: int = 5, digits: int = 2,
                  **kw) -> DataFrame:
    """Fill NULL ``target`` with the rounded mean of its k nearest complete rows (H3)."""
    train = df.filter(qcol(target).isNotNull())
    need = df.filter(qcol(target).isNull())
    pred = knn_predict(train, need, key, features, target, k, **kw)
    out = df.join(pred.select(key, "prediction"), on=key, how="left")
    return out.withColumn("imputed", qcol(target).isNull()).withColumn(
        target, F.coalesce(qcol(target), F.bround("prediction", digits))).drop("prediction")


# --------------------------------------------------------------------------------------------- H3 + H4 (k tuning)
def knn_cv(df: DataFrame, key: str, features: str, target: str, ks=(5, 7, 9), folds: int = 10, repeats: int = 3,
           seed: int = 123, pivots: int = KNN_PIVOTS, block: int = KNN_BLOCK, fold_of=None) -> DataFrame:
    """Repeated k-fold CV of the exact kNN regressor for several k at once (H3 tuned as in H4).

    A row's fold in repeat r is a hash of its key, or ``fold_of(r)``, an integer column from 0 to ``folds`` - 1.

    Every labelled row is a query; its neighbours from the same fold are left out per repeat, so one search
    (:func:`_nearest`) serves all folds, repeats and k. Output: per (k, repeat, fold) the metrics of
    :func:`regression_metrics`.
    """
    from gustlab.operators.evaluate import regression_metrics

    kmax = max(ks)
    lab = df.filter(qcol(target).isNotNull()).select(
        F.col(key).cast("long").alias("__tk"), F.col(features).cast("array<double>").alias("__x"),
        F.col(target).cast("double").alias("__y"),
        F.array(*[(fold_of(r) if fold_of else F.pmod(F.xxhash64(F.col(key), F.lit(seed + r)), F.lit(folds))).cast("int")
                  for r in range(repeats)]).alias("__folds"))
    lab = cut_lineage(lab)
    top = _nearest(lab, lab.select(F.col("__tk").alias("__qk"), "__x", "__folds"), kmax, repeats, pivots, block)
    preds = top.groupBy("__qk", "__r").agg(*[F.avg(F.when(F.col("__rank") <= k, F.col("__y"))).alias(f"k{k}")
                                             for k in ks])
    preds = preds.unpivot(["__qk", "__r"], [f"k{k}" for k in ks], "__kname", "prediction")
    truth = lab.select(F.col("__tk").alias("__qk"), F.col("__y").alias("actual"), "__folds")
    j = preds.join(truth, on="__qk").withColumn("fold", F.element_at("__folds", F.col("__r") + 1)).withColumn(
        "k", F.regexp_extract("__kname", r"k(\d+)", 1).cast("int")).withColumnRenamed("__r", "repeat")
    return regression_metrics(j, "actual", "prediction", by=["k", "repeat", "fold"])


def best_k(cv: DataFrame) -> int:
    """The k with the least mean fold RMSE (caret's bestTune)."""
    return int(cv.groupBy("k").agg(F.avg("rmse").alias("m")).orderBy("m", "k").first()["k"])
