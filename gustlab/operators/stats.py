"""Statistics: summaries, quantile bins, ranks and correlation-based selection.

Ranks and quantiles are exact and distributed: values are counted first, so ties are one row; the distinct values
are range-partitioned, range totals give offsets, and prefix sums run inside the ranges.
Only per-column or per-pair results (at most columns²) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustlab.functions.columns import qcol
from gustlab.functions.stats_math import cor_test_p_udf
from gustlab.operators.timeseries import ROWS_PER_BUCKET, null_safe_join, range_buckets


# --------------------------------------------------------------------------------------------- D10
def column_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), feature: str = "feature") -> DataFrame:
    """Count, mean, sum, sample sd, min and max per column (and group), long form."""
    by = list(by)
    long = df.unpivot(by, list(cols), feature, "__v")
    v = F.col("__v")
    return long.groupBy(*by, feature).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("sum"),
        F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


# --------------------------------------------------------------------------------------------- quantiles
def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics (R type 7), per group.

    ``h = (n-1)p``; value ``x[floor h] + (h - floor h)(x[floor h + 1] - x[floor h])``. The distinct values with
    their cumulated counts cover the positions, so the two values of a quantile are those whose ranges hold its
    positions; output ``(by..., p, q)``.
    """
    by = list(by)
    v = df.select(*by, qcol(col).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    counts = v.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))
    pc = _prefix_counts(counts, by, "__x", "__c")
    n = pc.groupBy(*by).agg(F.sum("__c").alias("__n"))
    pc = null_safe_join(pc, n, by) if by else pc.withColumn("__n", F.lit((n.first() or {"__n": 0})["__n"]))
    h = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    lo = lambda p: F.floor(h(p)).cast("long")
    hi = lambda p: F.least(lo(p) + 1, F.col("__n") - 1)
    holds = lambda at: (F.col("__below") <= at) & (at < F.col("__below") + F.col("__c"))
    hits = F.filter(F.array(*[F.struct(F.lit(float(p)).alias("p"), (h(p) - lo(p)).alias("w"), holds(lo(p)).alias("lo"),
                                       holds(hi(p)).alias("hi")) for p in probs]), lambda s: s["lo"] | s["hi"])
    found = pc.select(*by, "__x", F.explode(hits).alias("__s")).groupBy(*by, F.col("__s.p").alias("p")).agg(
        F.first("__s.w").alias("w"), F.max(F.when(F.col("__s.lo"), F.col("__x"))).alias("__xlo"),
        F.max(F.when(F.col("__s.hi"), F.col("__x"))).alias("__xhi"))
    q = F.col("__xlo") + F.col("w") * (F.col("__xhi") - F.col("__xlo"))
    return found.select(*by, "p", q.alias("q"))


# --------------------------------------------------------------------------------------------- D12
def decile_calibration(df: DataFrame, actual: str, pred: str, bins: int = 10) -> DataFrame:
    """Bins of the prediction at its quantiles (right-closed, lowest included); mean actual and predicted per bin.

    The ``bins - 1`` inner breaks come to the driver; ``bucket = 1 + #(breaks < pred)``.
    """
    probs = [i / bins for i in range(1, bins)]
    br = [r["q"] for r in exact_quantiles(df, pred, probs).orderBy("p").collect()]
    bucket = F.lit(1)
    for b in br:
        bucket = bucket + F.when(qcol(pred) > F.lit(b), 1).otherwise(0)
    return (df.filter(qcol(pred).isNotNull()).withColumn("bucket", bucket.cast("int"))
            .groupBy("bucket").agg(F.avg(actual).alias("mean_actual"), F.avg(pred).alias("mean_predicted"),
                                   F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------------------------- E9
def _prefix_counts(counts: DataFrame, by: Sequence[str], value: str, weight: str,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exclusive prefix sum of ``weight`` over distinct ``value`` within ``by`` (``__below``); NULL groups are a group."""
    by = list(by)
    n = counts.count()
    nb = max(1, math.ceil(n / rows_per_bucket))
    order = F.col(value).asc_nulls_first()
    w_in = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if nb == 1:
        return counts.withColumn("__below", F.coalesce(F.sum(weight).over(w_in), F.lit(0)))
    c = range_buckets(counts, [*by, value], nb)
    tot = c.groupBy(*by, "_bkt").agg(F.sum(weight).alias("__t"))
    wo = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__t").over(wo), F.lit(0))).drop("__t")
    c = null_safe_join(c, off, [*by, "_bkt"])
    wb = Window.partitionBy(*by, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("__below", F.col("__off") + F.coalesce(F.sum(weight).over(wb), F.lit(0))).drop(
        "_bkt", "__off", "_tie")


def average_rank_table(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Distinct ``(by..., value) -> average rank`` (ties share the mean of their positions)."""
    by = list(by)
    counts = df.filter(qcol(value).isNotNull()).groupBy(*by, qcol(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("__c"))
    pc = _prefix_counts(counts, by, value, "__c")
    return pc.select(*by, value, (F.col("__below") + (F.col("__c") + 1) / 2.0).alias(out))


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Attach the average rank of ``value`` within ``by`` to every row (equi-join on the value)."""
    t = average_rank_table(df, value, by, out)
    key = "__value"
    keyed = df.withColumn(key, qcol(value).cast("double"))
    return null_safe_join(keyed, t.withColumnRenamed(value, key), [*by, key], "left").drop(key)


# --------------------------------------------------------------------------------------------- D15
def correlate(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Each column against ``target``: Spearman (average ranks) and Pearson coefficients on pairwise complete rows.

    Long form ``(t, var, val)``; the ranks of both sides are taken within each pair's complete rows.
    Output ``(x_var, y_var, n, cor_coef, pearson_r)``; both coefficients are NULL where a side is constant.
    """
    long = df.select(qcol(target).cast("double").alias("__t"), *[qcol(c).cast("double").alias(c) for c in cols])
    long = long.unpivot(["__t"], list(cols), "y_var", "__v").filter(
        F.col("__t").isNotNull() & F.col("__v").isNotNull())
    rv = average_rank_table(long, "__v", ["y_var"], "__rv")
    rt = average_rank_table(long, "__t", ["y_var"], "__rt")
    j = long.join(rv, on=["y_var", "__v"]).join(rt, on=["y_var", "__t"])
    return j.groupBy("y_var").agg(
        F.count(F.lit(1)).alias("n"), _corr("__rv", "__rt").alias("cor_coef"),
        _corr("__v", "__t").alias("pearson_r")).select(F.lit(target).alias("x_var"), "*")


def _corr(a: str, b: str) -> Column:
    """Pearson coefficient, NULL where a side is constant (``F.corr`` divides by zero there)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def correlation_test(df: DataFrame, target: str, cols: Sequence[str], min_abs: float = 0.75,
                     max_p: float = 0.05, p_method: str = "pearson") -> DataFrame:
    """Significant, strong correlates of ``target`` sorted by |coefficient|.

    As the reference: the coefficient is Spearman, the p-value comes from the default (Pearson) test;
    ``p_method="spearman"`` tests the Spearman coefficient instead.
    """
    c = correlate(df, target, cols)
    r_for_p = F.col("pearson_r") if p_method == "pearson" else F.col("cor_coef")
    c = c.withColumn("p_val", cor_test_p_udf(r_for_p, F.col("n").cast("double")))
    return c.filter((F.col("p_val") < max_p) & (F.abs("cor_coef") >= min_abs)).orderBy(F.abs("cor_coef").desc())


# --------------------------------------------------------------------------------------------- D16, D17
def rank_columns(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Each column replaced by its average rank, one row per input row, through one long-form rank table.

    Rows are told apart by ``key`` and a number among rows of equal key (rows that are equal in the key and all columns
    are interchangeable), so repeated keys keep all their rows.
    """
    key = list(key)
    data = df.select(*key, *[qcol(c).cast("double").alias(c) for c in cols])
    w = Window.partitionBy(*key).orderBy(*[qcol(c) for c in cols])
    data = data.withColumn("__row", F.row_number().over(w))
    long = data.unpivot([*key, "__row"], list(cols), "__var", "__v")
    ranks = average_rank_table(long, "__v", ["__var"], "__r")
    rl = null_safe_join(long, ranks, ["__var", "__v"], "left")
    return rl.groupBy(*key, "__row").pivot("__var", list(cols)).agg(F.first("__r")).drop("__row")


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson",
                       key: Sequence[str] | None = None) -> DataFrame:
    """Pairwise correlations ``(x, y, n, r)`` for every pair ``x < y`` in column order.

    Complete rows only; one plan at any width: MLlib's distributed Gram-matrix correlation, whose
    columns x columns result is all that reaches the driver. A constant column has ``r`` NULL, as have fewer than two
    rows. Spearman ranks the columns first (needs a row ``key``).
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    cols = list(cols)
    data = df.na.drop("any", subset=cols)
    if method == "spearman":
        if not key:
            raise ValueError("spearman needs a row key")
        data = rank_columns(data, cols, key)
    elif method != "pearson":
        raise ValueError(method)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    stats = [x for i, c in enumerate(cols) for x in (F.min(qcol(c)).alias(f"lo{i}"), F.max(qcol(c)).alias(f"hi{i}"))]
    vec = VectorAssembler(inputCols=cols, outputCol="__v").transform(data.select(*[qcol(c) for c in cols])).cache()
    head = vec.agg(F.count(F.lit(1)).alias("n"), *stats).first()
    n = int(head["n"])
    varies = {c: n > 1 and head[f"lo{i}"] != head[f"hi{i}"] for i, c in enumerate(cols)}
    m = Correlation.corr(vec, "__v", "pearson").first()[0].toArray() if n > 1 else None
    vec.unpersist()
    idx = {c: i for i, c in enumerate(cols)}
    rows = [(a, b, n, float(m[idx[a], idx[b]]) if varies[a] and varies[b] else None) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "x string, y string, n long, r double")


def correlation_pvalues(matrix: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value per pair from ``t = r sqrt((n-2)/(1-r²))`` and a significance flag."""
    m = matrix.withColumn("p_val", cor_test_p_udf(F.col("r"), F.col("n").cast("double")))
    return m.withColumn("significant", F.col("p_val") < alpha)


# --------------------------------------------------------------------------------------------- D18, D19
def find_correlated(names: Sequence[str], r: dict[tuple[str, str], float], cutoff: float = 0.75) -> list[str]:
    """Greedy pick of columns to drop so no kept pair exceeds ``cutoff`` in |r|.

    Columns are visited by decreasing mean |r|; for a pair over the cutoff the member with the larger mean
    |r| over the still-kept columns is dropped. Runs on a columns x columns matrix.
    """
    names = list(names)

    def a(i, j):
        return abs(r.get((i, j), r.get((j, i), 0.0)) or 0.0)

    def mean_abs(i, kept):
        others = [j for j in kept if j != i]
        return sum(a(i, j) for j in others) / len(others) if others else 0.0

    order = sorted(names, key=lambda c: -mean_abs(c, names))
    dropped: set[str] = set()
    for ii, i in enumerate(order):
        if i in dropped:
            continue
        for j in order[ii + 1:]:
            if j in dropped or i in dropped:
                continue
            if a(i, j) > cutoff:
                kept = [c for c in order if c not in dropped]
                if mean_abs(i, kept) > mean_abs(j, kept):
                    dropped.add(i)
                else:
                    dropped.add(j)
    return [c for c in order if c in dropped]


def prune_correlated(df: DataFrame, cols: Sequence[str], cutoff: float = 0.75, method: str = "spearman",
                     key: Sequence[str] | None = None) -> list[str]:
    """Columns to drop (D18): the matrix is computed on Spark, the greedy pass on its columns² entries."""
    m = correlation_matrix(df, cols, method, key).collect()
    r = {(row["x"], row["y"]): row["r"] for row in m}
    return find_correlated(cols, r, cutoff)


def select_by_correlation(df: DataFrame, target: str, speed: str, cols: Sequence[str], key: Sequence[str],
                          speed_cutoff: float = 0.7, cutoff: float = 0.75, max_p: float = 0.05) -> list[str]:
    """The reference's feature selection (D19): drop columns with |ρ| >= 0.7 against wind speed (except the
    target), keep those significantly correlated with the target, then prune mutually correlated ones."""
    cand = [c for c in cols if c not in (target, speed)]
    with_speed = {r["y_var"] for r in correlation_test(df, speed, cand, speed_cutoff, max_p).collect()}
    cand = [c for c in cand if c not in with_speed]
    keep = [r["y_var"] for r in correlation_test(df, target, cand, 0.0, max_p).collect()]
    drop = prune_correlated(df, keep, cutoff, "spearman", key) if len(keep) > 1 else []
    return [c for c in keep if c not in drop]


