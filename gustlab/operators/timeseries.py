"""Hourly aggregation, ordered-series operators and forecasting helpers.

Ordered operators never put a whole series into one task: positions come from :func:`sequence_index`, which
buckets the order column by approximate quantiles and numbers rows inside each bucket; ``lead``/``lag``/ACF are
then equi-joins on ``position ± k``. ``method="window"`` keeps the plain window plan for series known to be short.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.session import cut_lineage

IDX = "_pos"


# --------------------------------------------------------------------------------------------- D1, D2
def hourly_farm(df: DataFrame, features: Sequence[str], ts: str = "ts", turbine: str = "turbine",
                turbines: Sequence[str] | None = None, farm_agg: str = "max", digits: int | None = 3,
                site: Sequence[str] = (), period: str = "1 hour", pivot: bool = True) -> DataFrame:
    """10-minute turbine rows -> one row per site and hour.

    Per turbine the hour is the mean of its readings; the farm value is the ``max`` (reference) or ``mean``
    over turbines, column by column, then rounded half-even.

    With ``turbines`` given only these take part, and the per-turbine means are pivoted inside ONE aggregation
    keyed by the hour, so the plan has a single exchange with map-side partial aggregation (skewed hours
    collapse before the shuffle). Without it, or with ``pivot=False`` (the caller's choice for many turbines, same
    result), two aggregations run (turbine-hour, then hour).
    """
    hour = F.window(ts, period).start.alias(ts)
    site = list(site)
    clean = [null_if_nan(qcol(c)).alias(c) for c in features]
    base = df.select(*[qcol(s) for s in site], qcol(turbine).alias(turbine), hour, *clean)
    if turbines:
        turbines = list(turbines)
        base = base.filter(qcol(turbine).isin(turbines))
    if turbines and pivot:
        aggs = [F.avg(F.when(F.col(turbine) == t, qcol(c))).alias(f"{c}__{i}")
                for c in features for i, t in enumerate(turbines)]
        per = base.groupBy(*site, ts).agg(*aggs)
        out_cols = []
        for c in features:
            parts = [F.col(f"{c}__{i}") for i in range(len(turbines))]
            if farm_agg == "max":
                v = F.greatest(*parts) if len(parts) > 1 else parts[0]
            elif farm_agg == "mean":
                arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
                v = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)
                v = F.when(F.size(arr) > 0, v)
            else:
                raise ValueError(farm_agg)
            out_cols.append((F.bround(v, digits) if digits is not None else v).alias(c))
        return per.select(*site, ts, *out_cols)
    per_turbine = base.groupBy(*site, turbine, ts).agg(*[F.avg(c).alias(c) for c in features])
    agg = {"max": F.max, "mean": F.avg}[farm_agg]
    farm = per_turbine.groupBy(*site, ts).agg(*[agg(c).alias(c) for c in features])
    return farm.select(*site, ts, *[(F.bround(c, digits) if digits is not None else F.col(c)).alias(c)
                                    for c in features])


# --------------------------------------------------------------------------------------------- positions
ROWS_PER_BUCKET = 500_000


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match each other; the left side's key columns are kept."""
    r = right.select(*[qcol(c).alias(f"__r_{c}") if c in on else qcol(c) for c in right.columns])
    cond = F.lit(True)
    for i, c in enumerate(on):
        eq = qcol(c).eqNullSafe(qcol(f"__r_{c}"))
        cond = eq if i == 0 else cond & eq
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def range_buckets(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows in ``n`` ranges of ``keys`` (NULLs first), the range number as ``_bkt``.

    Rows equal in all keys are divided too: a row number of the scan (``_tie``) ends the sort keys. The bounds stay
    inside Spark's range partitioner, and the dealt rows are written to the shared checkpoint folder, so the
    ranges are the same for all readers.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *[qcol(c).asc_nulls_first() for c in keys], "_tie")
    return cut_lineage(dealt.withColumn("_bkt", F.spark_partition_id().cast("double")))


def sequence_index(df: DataFrame, order: str, by: Sequence[str] = (), idx: str = IDX,
                   rows_per_bucket: int = ROWS_PER_BUCKET, tiebreak: Sequence[str] = (),
                   n_rows: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """Add the 0-based position of each row within ``by`` ordered by ``order`` (then ``tiebreak``), NULLs first; see
    :func:`_positions`."""
    return _positions(df, order, by, idx, rows_per_bucket, tiebreak, n_rows, keep_bucket)[0]


def _positions(df: DataFrame, order: str, by: Sequence[str] = (), idx: str = IDX,
               rows_per_bucket: int = ROWS_PER_BUCKET, tiebreak: Sequence[str] = (),
               n_rows: int | None = None, keep_bucket: bool = False) -> tuple[DataFrame, int]:
    """Positions as in :func:`sequence_index`, plus the number of buckets used.

    Up to ``rows_per_bucket`` counted rows are numbered by one window. More are dealt to ranges
    (:func:`range_buckets`), numbered inside each range, and the ranges' counts per series give the offsets. NULL
    series keys are a series, NULL order values come first, and ties are divided; both plans give the same
    positions. ``keep_bucket`` keeps the range number as ``_bkt`` (0 when there is one).
    """
    by = list(by)
    n = df.count() if n_rows is None else n_rows
    nb = max(1, math.ceil(n / rows_per_bucket))
    ordering = [F.col(order).asc_nulls_first()] + [F.col(t).asc_nulls_first() for t in tiebreak]
    if nb == 1:
        w = Window.partitionBy(*by).orderBy(*ordering)
        out = df.withColumn(idx, F.row_number().over(w) - 1)
        return (out.withColumn("_bkt", F.lit(0.0)) if keep_bucket else out), 1
    tmp = range_buckets(df, [*by, order, *tiebreak], nb)
    counts = tmp.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    j = null_safe_join(tmp, offsets, [*by, "_bkt"])
    w = Window.partitionBy(*by, "_bkt").orderBy(*ordering, "_tie")
    out = j.withColumn(idx, (F.col("_off") + F.row_number().over(w) - 1).cast("long")).drop("_off", "_tie")
    return (out if keep_bucket else out.drop("_bkt")), nb


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-series values: an equi-join on ``by``; with no series key the single row is read as literals."""
    if by:
        return null_safe_join(df, per_group, list(by), "left")
    row = per_group.first()
    if row is None:
        return df.withColumns({c: F.lit(None) for c in per_group.columns})
    return df.withColumns({c: F.lit(row[c]) for c in per_group.columns})


def positioned_lags(ix: DataFrame, nb: int, by: Sequence[str], col: str, ks: Sequence[int],
                    prefix: str) -> DataFrame:
    """``{prefix}{k}`` = value of ``col`` k positions earlier, for every k in ``ks`` (k >= 1), on a frame from
    :func:`_positions` with ``keep_bucket``: windowed ``lag()`` per bucket, edge rows fixed by a small join."""
    by = list(by)
    w = Window.partitionBy(*by, "_bkt").orderBy(IDX)
    res = ix.select("*", *[F.lag(col, k).over(w).alias(f"{prefix}{k}") for k in ks])
    if nb > 1 and ks:
        kmax = max(ks)
        wb = Window.partitionBy(*by, "_bkt")
        e = res.withColumn("__lo", F.min(IDX).over(wb)).withColumn("__hi", F.max(IDX).over(wb))
        tails = e.filter(F.col(IDX) > F.col("__hi") - kmax).select(*by, F.col(IDX).alias("__sp"), F.col(col).alias("__sv"))
        heads = e.filter(F.col(IDX) < F.col("__lo") + kmax).select(*by, IDX, "__lo")
        pairs = heads.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("__k")).withColumn(
            "__sp", F.col(IDX) - F.col("__k")).filter(F.col("__sp") < F.col("__lo"))
        fix = null_safe_join(pairs, tails, [*by, "__sp"]).groupBy(*by, IDX).pivot("__k", list(ks)).agg(F.first("__sv"))
        fix = fix.select(*by, IDX, *[F.col(str(k)).alias(f"__e{k}") for k in ks])
        res = null_safe_join(res, fix, [*by, IDX], "left").withColumns(
            {f"{prefix}{k}": F.coalesce(F.col(f"{prefix}{k}"), F.col(f"__e{k}")) for k in ks}).drop(
            *[f"__e{k}" for k in ks])
    return res


# --------------------------------------------------------------------------------------------- E1-E4
def lead_value(df: DataFrame, col: str, k: int = 1, order: str = "ts", by: Sequence[str] = (),
               out: str | None = None, wrap: bool = False, method: str = "index",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Value ``k`` rows ahead within ``by``; ``k < 0`` looks back.

    ``wrap=True`` reproduces the reference default (T10): past the end the series' first value.
    """
    out = out or f"{col}_lead{k}"
    by = list(by)
    if method == "window":
        w = Window.partitionBy(*by).orderBy(order)
        v = F.lead(col, k).over(w) if k >= 0 else F.lag(col, -k).over(w)
        if wrap:
            first = F.first(col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            v = F.coalesce(v, first)
        return df.withColumn(out, v)
    ix, nb = _positions(df, order, by, rows_per_bucket=rows_per_bucket, keep_bucket=True)
    w = Window.partitionBy(*by, "_bkt").orderBy(IDX)
    res = ix.withColumn(out, F.lead(col, k).over(w) if k >= 0 else F.lag(col, -k).over(w))
    if nb > 1 and k != 0:
        # partners in the neighbouring bucket: only the |k| rows at each bucket edge take part
        wb = Window.partitionBy(*by, "_bkt")
        e = res.withColumn("__lo", F.min(IDX).over(wb)).withColumn("__hi", F.max(IDX).over(wb))
        near = (F.col(IDX) > F.col("__hi") - k) if k > 0 else (F.col(IDX) < F.col("__lo") - k)
        far = (F.col(IDX) < F.col("__lo") + k) if k > 0 else (F.col(IDX) > F.col("__hi") + k)
        src = e.filter(far).select(*by, (F.col(IDX) - k).alias(IDX), F.col(col).alias("__edge"))
        fix = null_safe_join(e.filter(near).select(*by, IDX), src, [*by, IDX])
        res = null_safe_join(res, fix, [*by, IDX], "left").withColumn(out, F.coalesce(F.col(out), F.col("__edge"))).drop(
            "__edge")
    res = res.drop("_bkt")
    if wrap:
        first = ix.filter(F.col(IDX) == 0).select(*by, F.col(col).alias("__first"))
        res = attach(res, first, by)
        res = res.withColumn(out, F.coalesce(F.col(out), F.col("__first"))).drop("__first")
    return res.drop(IDX)


def lag_value(df: DataFrame, col: str, k: int = 1, order: str = "ts", by: Sequence[str] = (),
              out: str | None = None, method: str = "index") -> DataFrame:
    return lead_value(df, col, -k, order, by, out or f"{col}_lag{k}", method=method)


def difference(df: DataFrame, col: str, k: int = 1, order: str = "ts", by: Sequence[str] = (),
               wrap: bool = True, method: str = "index", lead_col: str | None = None,
               diff_col: str | None = None) -> DataFrame:
    """``lead = x(t+k)``, ``diff = x(t) - x(t+k)`` (E3), wrap at the end as the reference does."""
    lead_col = lead_col or f"{col}_lead"
    diff_col = diff_col or f"{col}_diff"
    d = lead_value(df, col, k, order, by, lead_col, wrap=wrap, method=method)
    return d.withColumn(diff_col, F.col(col) - F.col(lead_col))


def undifference(df: DataFrame, pred_diff: str, actual: str, lead_col: str, k: int = 1,
                 order: str = "ts", by: Sequence[str] = (), mode: str = "causal",
                 out: str = "predicted_power", method: str = "index") -> DataFrame:
    """Predicted difference -> predicted level, aligned with the actual at the same row.

    ``mode="causal"``: forecast made at t for t+k is ``x(t) - d̂(t)``, shifted k rows forward.
    ``mode="reference"``: ``d̂ + lead`` shifted k rows forward, i.e. ``d̂(t-k) + x(t)`` (uses the answer).
    Rows without a forecast are dropped, as the reference does with ``na.omit``.
    """
    if mode == "causal":
        base = df.withColumn("__f", F.col(actual) - F.col(pred_diff))
    elif mode == "reference":
        base = df.withColumn("__f", F.col(pred_diff) + F.col(lead_col))
    else:
        raise ValueError(mode)
    res = lag_value(base, "__f", k, order, by, out, method=method).drop("__f")
    return res.filter(F.col(out).isNotNull())


# --------------------------------------------------------------------------------------------- E8
def zscore_fit(df: DataFrame, cols: Sequence[str], fit_filter: Column | None = None) -> dict:
    """Mean and sample sd per column (like R ``scale``); one aggregate, a few numbers to the driver."""
    src = df.filter(fit_filter) if fit_filter is not None else df
    aggs = []
    for c in cols:
        aggs += [F.avg(qcol(c)).alias(f"m_{c}"), F.stddev_samp(qcol(c)).alias(f"s_{c}")]
    row = src.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def zscore(df: DataFrame, cols: Sequence[str], fit_filter: Column | None = None,
           stats: dict | None = None, centre_constant: bool = False) -> DataFrame:
    """Centre and scale ``cols``; fit on all rows (reference, T13) or on ``fit_filter`` rows only. A constant column
    gives NULL, or with ``centre_constant`` is centred only, so that models keep the rows (an input that tells nothing)."""
    stats = stats or zscore_fit(df, cols, fit_filter)
    if centre_constant:
        stats = {c: (m, s or 1.0) for c, (m, s) in stats.items()}
    return df.withColumns({c: F.try_divide(qcol(c) - F.lit(m), F.lit(s).cast("double")) for c, (m, s) in stats.items()})


# --------------------------------------------------------------------------------------------- E10-E12
QNORM_975 = 1.959963984540054  # qnorm(0.975), fixed value


def acf(df: DataFrame, col: str, max_lag: int, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation per lag 0..max_lag: ``Σ(x_i−m)(x_{i+h}−m) / Σ(x−m)²`` with the significance band.

    Lagged products come from one window of ``lag()`` columns over each position bucket (one sort, no
    fan-out); only pairs that straddle a bucket edge (at most max_lag rows on each side of every edge) go
    through a small join.
    """
    by = list(by)
    base = df.select(*by, order, col).filter(F.col(col).isNotNull())
    ix = sequence_index(base, order, by, keep_bucket=True)
    stats = ix.groupBy(*by).agg(F.avg(col).alias("__m"), F.count(F.lit(1)).alias("n"))
    c = attach(ix, stats, by).withColumn("__d", F.col(col) - F.col("__m"))
    w = Window.partitionBy(*by, "_bkt").orderBy(IDX)
    lags = range(1, max_lag + 1)
    within = c.select(*by, (F.col("__d") * F.col("__d")).alias("__p0"),
                      *[(F.col("__d") * F.lag("__d", h).over(w)).alias(f"__p{h}") for h in lags])
    sums = within.groupBy(*by).agg(*[F.sum(f"__p{h}").alias(f"__p{h}") for h in range(0, max_lag + 1)])
    num = sums.unpivot(by, [f"__p{h}" for h in range(0, max_lag + 1)], "__lag", "__within").select(
        *by, F.regexp_extract("__lag", r"(\d+)", 1).cast("long").alias("lag"), "__within")
    # pairs across bucket edges: the last max_lag rows of a bucket meet the first max_lag rows of later ones
    wb = Window.partitionBy(*by, "_bkt")
    edges = c.withColumn("__lo", F.min(IDX).over(wb)).withColumn("__hi", F.max(IDX).over(wb))
    tails = edges.filter(F.col(IDX) > F.col("__hi") - max_lag).select(
        *by, F.col("_bkt").alias("__tb"), F.col(IDX).alias("__tp"), F.col("__d").alias("__dt"))
    heads = edges.filter(F.col(IDX) < F.col("__lo") + max_lag).select(
        *by, F.col("_bkt").alias("__hb"), F.col(IDX).alias("__hp"), F.col("__d").alias("__dh"))
    fan = tails.select("*", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")).withColumn(
        "__hp", F.col("__tp") + F.col("lag"))
    cross = null_safe_join(fan, heads, [*by, "__hp"]).filter(F.col("__tb") != F.col("__hb")).groupBy(*by, "lag").agg(
        F.sum(F.col("__dt") * F.col("__dh")).alias("__cross"))
    num = null_safe_join(num, cross.withColumn("lag", F.col("lag").cast("long")), [*by, "lag"], "left")
    num = num.withColumn("__num", F.col("__within").cast("double") + F.coalesce(F.col("__cross"), F.lit(0.0)))
    den = sums.select(*by, F.col("__p0").alias("__den"))
    r = attach(attach(num, den, by), stats.select(*by, "n"), by)
    ci = F.lit(QNORM_975) / F.sqrt(F.col("n"))
    val = F.try_divide(F.col("__num"), F.col("__den"))  # NULL for a constant series
    return r.select(*by, F.col("lag").cast("long").alias("lag"), val.alias("acf"), ci.alias("ci"),
                    (F.abs(val) > ci).alias("significant"), F.col("n").cast("long").alias("n"))


def ljung_box(acf_df: DataFrame, lags: int, fitted_params: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Ljung–Box Q over lags 1..``lags`` from an :func:`acf` frame, with its chi-square p-value."""
    from gustlab.functions.stats_math import chi2_sf_udf

    by = list(by)
    a = acf_df.filter((F.col("lag") >= 1) & (F.col("lag") <= lags))
    q = a.groupBy(*by).agg(
        (F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("q_stat"))
    dof = F.lit(lags - fitted_params).cast("double")
    return q.withColumn("df", dof).withColumn("p_value", chi2_sf_udf(F.col("q_stat"), F.col("df")))


# --------------------------------------------------------------------------------------------- E13, E14
def temporal_split(df: DataFrame, test_start: str, train_days: int, test_days: int, val_days: int = 0,
                   horizon_hours: int = 1, ts: str = "ts", label: str = "split") -> DataFrame:
    """Label rows train / validation / test by timestamp.

    As the reference: ``test = test_start - horizon``; train ``[test - train_days, val)``,
    validation ``[val, test)`` with ``val = test - val_days + horizon`` (or none), test ``[test, test + test_days + horizon]``.
    A horizon beyond ``val_days`` leaves no validation rows; training rows still end before ``test``.
    """
    t = F.lit(test_start).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(horizon_hours))
    start = t - F.make_dt_interval(F.lit(train_days))
    end = t + F.make_dt_interval(F.lit(test_days), F.lit(horizon_hours))
    c = F.col(ts)
    if val_days:
        v = t - F.make_dt_interval(F.lit(val_days)) + F.make_dt_interval(F.lit(0), F.lit(horizon_hours))
        lab = (F.when((c >= start) & (c < F.least(v, t)), "train").when((c >= v) & (c < t), "validation")
               .when((c >= t) & (c <= end), "test"))
    else:
        lab = F.when((c >= start) & (c < t), "train").when((c >= t) & (c <= end), "test")
    return df.withColumn(label, lab)


def sequence_windows(df: DataFrame, cols: Sequence[str], steps: int, order: str = "ts",
                     by: Sequence[str] = (), out: str = "seq", method: str = "window") -> DataFrame:
    """For each row, the last ``steps`` rows' feature values (oldest first) as ``array<array<double>>``.

    ``method="window"``: ``lag()`` over each position bucket builds the arrays with one sort; only the first
    ``steps - 1`` rows of a bucket, whose history reaches into the previous bucket, are rebuilt from a small
    fan-out of the rows next to bucket edges. ``method="fanout"`` copies every row to the ``steps`` positions
    that include it (work rows x steps). Rows with fewer than ``steps`` predecessors get a shorter array.
    """
    by = list(by)
    feats = F.array(*[F.col(c).cast("double") for c in cols])
    if method == "fanout":
        ix = sequence_index(df, order, by)
        fan = _fanout_windows(ix.select(*by, IDX, feats.alias("__f")), by, steps, out)
        return null_safe_join(ix, fan, [*by, IDX]).drop(IDX)
    ix, nb = _positions(df, order, by, keep_bucket=True)
    ix = ix.withColumn("__f", feats)
    w = Window.partitionBy(*by, "_bkt").orderBy(IDX)
    hist = F.array(*[F.lag("__f", j).over(w) for j in range(steps - 1, 0, -1)], F.col("__f"))
    res = ix.withColumn(out, F.filter(hist, lambda x: x.isNotNull()))
    if nb > 1 and steps > 1:
        wb = Window.partitionBy(*by, "_bkt")
        e = res.withColumn("__lo", F.min(IDX).over(wb)).withColumn("__hi", F.max(IDX).over(wb))
        near = e.filter(F.col(IDX) < F.col("__lo") + steps - 1)
        src = e.filter((F.col(IDX) < F.col("__lo") + steps - 1) | (F.col(IDX) > F.col("__hi") - steps + 1))
        fixed = _fanout_windows(src.select(*by, IDX, "__f"), by, steps, "__fixed")
        fixed = null_safe_join(fixed, near.select(*by, IDX), [*by, IDX])
        res = null_safe_join(res, fixed, [*by, IDX], "left").withColumn(
            out, F.coalesce(F.col("__fixed"), F.col(out))).drop("__fixed")
    return res.drop("__f", "_bkt", IDX)


def _fanout_windows(rows: DataFrame, by: list[str], steps: int, out: str) -> DataFrame:
    """``(by..., position, out)``: each row copied to the ``steps`` positions whose window includes it."""
    fan = rows.select(*by, F.col(IDX).alias("__src"), "__f",
                      F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("__j"))
    fan = fan.withColumn(IDX, F.col("__src") + F.col("__j"))
    grouped = fan.groupBy(*by, IDX).agg(F.array_sort(F.collect_list(F.struct(F.col("__src"), F.col("__f")))).alias("__l"))
    return grouped.select(*by, IDX, F.transform("__l", lambda x: x["__f"]).alias(out))
