"""Scoring: regression metrics, CV summaries, model comparison, back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keras backend epsilon, used by the reference's R² metric.
KERAS_EPSILON = 1e-7


def metric_columns(actual: Column, pred: Column, eps: float = KERAS_EPSILON) -> list[Column]:
    """Aggregate expressions for MAE, RMSE, MAPE, two R² variants and mean error %.

    MAPE skips zero actuals (R would divide by zero); they are counted in ``n_zero``.
    ``r2`` is ``1 − SSE/(SST + ε)``; ``r2_corr`` is the squared Pearson correlation (caret's Rsquared), NULL
    where either side is constant; ``mean_error_pct`` is NULL where the actuals' mean is 0.
    """
    err = pred - actual
    n = F.count(F.when(actual.isNotNull() & pred.isNotNull(), 1))
    sse = F.sum(err * err)
    both = actual.isNotNull() & pred.isNotNull()
    a, p = F.when(both, actual), F.when(both, pred)
    corr = F.try_divide(F.covar_pop(a, p), F.stddev_pop(a) * F.stddev_pop(p))
    sst = F.var_pop(F.when(pred.isNotNull(), actual)) * n
    return [
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(actual != 0, F.abs(F.try_divide(err, actual)))) * 100).alias("mape"),
        F.count(F.when((actual == 0) & pred.isNotNull(), 1)).alias("n_zero"),
        (1 - sse / (sst + F.lit(eps))).alias("r2"),
        F.pow(corr, 2).alias("r2_corr"),
        (F.try_divide(F.sqrt(F.avg(err * err)), F.avg(F.when(pred.isNotNull(), actual))) * 100).alias("mean_error_pct"),
    ]


def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = (),
                       eps: float = KERAS_EPSILON) -> DataFrame:
    """One row per group with the metrics of :func:`metric_columns` (H13): a single aggregate pass."""
    a, p = F.col(actual), F.col(pred)
    cols = metric_columns(a, p, eps)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def cv_summary(fold_metrics: DataFrame, model: str = "model", metrics: Sequence[str] = ("mae", "rmse", "r2_corr"),
               setting: str | None = None) -> DataFrame:
    """Min, quartiles, mean and max of per-fold metrics per model (caret ``resamples`` summary, H14)."""
    aggs = []
    for m in metrics:
        c = F.col(m)
        aggs += [F.min(c).alias(f"{m}_min"), F.percentile(c, 0.25).alias(f"{m}_q1"),
                 F.median(c).alias(f"{m}_median"), F.avg(c).alias(f"{m}_mean"),
                 F.percentile(c, 0.75).alias(f"{m}_q3"), F.max(c).alias(f"{m}_max")]
    keys = [model] + ([setting] if setting else [])
    return fold_metrics.groupBy(*keys).agg(*aggs)


def best_setting(summary: DataFrame, model: str = "model", setting: str = "setting",
                 metric: str = "rmse_mean") -> DataFrame:
    """Per model, the setting with the least mean metric (caret ``bestTune``)."""
    return summary.groupBy(model).agg(F.min_by(setting, metric).alias(f"best_{setting}"),
                                      F.min(metric).alias(metric))


def compare_models(base: DataFrame, key: Sequence[str], predictions: dict[str, DataFrame],
                   pred_col: str = "prediction") -> DataFrame:
    """One row per key with the actual and every model's prediction side by side.

    Column binding by position becomes equi-joins on the row key.
    """
    out = base
    for name, p in predictions.items():
        out = out.join(p.select(*key, F.col(pred_col).alias(f"pred_{name}")), on=list(key), how="left")
    return out
