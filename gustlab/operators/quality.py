"""Missing-value and variance audits.

Each audit is one aggregate pass over the data; only per-group summaries (groups x columns) leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import any_null, qcol


def _null_share(c: str):
    return F.avg(F.when(qcol(c).isNull(), 1.0).otherwise(0.0))


def missing_percent(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), digits: int = 3,
                    feature: str = "feature", value: str = "pct_missing") -> DataFrame:
    """Percent of NULL per column per group, long form ``(by..., feature, pct_missing)`` (D3).

    The caller names the columns; key columns such as the timestamp are excluded explicitly (T2).
    """
    aggs = [F.bround(_null_share(c) * 100, digits).alias(c) for c in cols]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return wide.unpivot(list(by), list(cols), feature, value)


def missing_report(long: DataFrame, by: str, feature: str = "feature", value: str = "pct_missing",
                   groups: Sequence[str] | None = None) -> DataFrame:
    """Transpose: one row per feature, one column per group."""
    return long.groupBy(feature).pivot(by, list(groups) if groups else None).agg(F.first(value))


def affected_groups(long: DataFrame, by: str = "month", value: str = "pct_missing",
                    digits: int = 2) -> DataFrame:
    """Groups with any missing value and their mean percent over features."""
    return (long.groupBy(by).agg(F.sum(value).alias("__s"), F.avg(value).alias("mean_pct_missing"))
            .filter(F.col("__s") != 0)
            .select(by, F.bround("mean_pct_missing", digits).alias("mean_pct_missing")))


def missing_rows(df: DataFrame, col: str, by: str = "month", turbine: str = "turbine",
                 turbines: Sequence[str] | None = None) -> DataFrame:
    """NULL count of ``col`` per group, one column per turbine (D5). Pass ``turbines`` to skip a distinct job."""
    n = F.sum(F.when(qcol(col).isNull(), 1).otherwise(0))
    return df.groupBy(by).pivot(turbine, list(turbines) if turbines else None).agg(n)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once, and how many surplus rows they hold."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return g.agg(F.count(F.lit(1)).alias("n_duplicated_keys"),
                 F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_surplus_rows"))


def zero_variance(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), scope: str = "any",
                  out: str = "feature") -> DataFrame:
    """Columns with a single distinct value (or none) within a group.

    One pass: per group ``min <=> max``; ``scope="any"`` is the reference's union over groups,
    ``"all"`` keeps columns constant in every group.
    """
    aggs = [F.min(qcol(c)).eqNullSafe(F.max(qcol(c))).alias(c) for c in cols]
    per = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    long = per.unpivot(list(by), list(cols), out, "__const")
    if scope == "any":
        return long.filter("__const").select(out).distinct()
    if scope == "all":
        return long.groupBy(out).agg(F.bool_and("__const").alias("__all")).filter("__all").select(out)
    raise ValueError(scope)


def drop_columns(df: DataFrame, names: DataFrame | Sequence[str], col: str = "feature") -> DataFrame:
    """Remove columns named by a list or by a small one-column frame."""
    if isinstance(names, DataFrame):
        names = [r[0] for r in names.select(col).collect()]
    return df.drop(*names)


def any_null_by(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Whether any NULL remains, per group."""
    e = F.bool_or(any_null(cols)).alias("has_null")
    return df.groupBy(*by).agg(e) if by else df.agg(e)


def file_audit(df: DataFrame, file_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, populated columns and their names per file."""
    cols = [c for c in (cols or df.columns) if c != file_col]
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [(F.count(qcol(c)) > 0).alias(c) for c in cols]
    per = df.groupBy(file_col).agg(*aggs)
    present = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return per.select(file_col, "n_rows", F.size(present).cast("long").alias("n_columns"),
                      F.array_join(F.array_sort(present), ",").alias("column_names"))


def missingness_profile(df: DataFrame, cols: Sequence[str], ts: str = "ts", bucket: str = "1 day",
                        feature: str = "feature") -> DataFrame:
    """NULL share per time bucket and column (D20, the data behind a missingness map)."""
    b = F.window(ts, bucket).start.alias("bucket")
    wide = df.groupBy(b).agg(*[_null_share(c).alias(c) for c in cols])
    return wide.unpivot(["bucket"], list(cols), feature, "null_share")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unique combinations."""
    return df.select(*cols).distinct()
