"""The reference's end-to-end paths as compositions of library operators.

Entry 3 (forecasting) is :func:`gustlab.operators.forecast.lagged_forecast` and
:func:`gustlab.operators.forecast.arima_forecast`, used directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import split_timestamp
from gustlab.operators import evaluate as EV
from gustlab.operators import impute as I
from gustlab.operators import joins as J
from gustlab.operators import models as M
from gustlab.operators import quality as Q
from gustlab.operators import reshape as R
from gustlab.operators import stats as ST
from gustlab.operators import timeseries as tsx
from gustlab.session import cut_lineage


def sensor_to_hourly(scada: DataFrame, features: Sequence[str], target: str, speed: str,
                     turbines: Sequence[str] | None = None, month: str = "filename", turbine: str = "turbine",
                     ts: str = "ts", select: bool = True) -> tuple[DataFrame, list[str]]:
    """Entry 1: long 10-minute SCADA -> hourly farm table with the selected features.

    Donor-year fill from the year before, then the year after (C2); rows still incomplete dropped; columns
    constant in any month x turbine dropped (D7, D8); hourly mean per turbine, max over turbines (D1);
    correlation-based selection (D19). Returns the table and the kept feature list.
    """
    feats = list(features)
    tagged = scada.withColumn(month, F.col(month))
    a = I.impute_from_donor(tagged, tagged, [turbine], feats, ts=ts, donor_years=1, tag_col=None,
                            drop_incomplete=False)
    # read by the variance audit and the aggregation: written to the shared checkpoint folder, so a lost
    # executor does not replay the two donor joins
    b = cut_lineage(I.impute_from_donor(a, tagged, [turbine], feats, ts=ts, donor_years=-1, tag_col=None))
    zv = [r[0] for r in Q.zero_variance(b, feats, by=[month, turbine]).collect()]
    kept = [c for c in feats if c not in zv]
    if not kept:
        raise ValueError("every feature is constant within some month x turbine group; nothing to aggregate")
    hourly = tsx.hourly_farm(b, kept, ts=ts, turbine=turbine, turbines=turbines, farm_agg="max")
    hourly = hourly.withColumn(month, F.date_format(ts, "MMMyyyy")).cache()  # several selection passes read it
    if select and target in kept and speed in kept:
        chosen = ST.select_by_correlation(hourly, target, speed, kept, key=[ts])
        cols = [c for c in kept if c in chosen or c in (target, speed)]
    else:
        cols = kept
    return hourly.select(month, ts, *cols), cols


def weather_to_final(hourly: DataFrame, weather: DataFrame, power: str, ts: str = "ts",
                     zero_fill: Sequence[str] = ("precip_intensity", "precip_probability"),
                     median_fill: Sequence[str] = ("wind_speed", "wind_bearing", "visibility"),
                     gust: str = "wind_gust", speed: str = "wind_speed", knn_target: str = "pressure",
                     knn_features: Sequence[str] | None = None, k: int = 5, refit: bool = False) -> DataFrame:
    """Entry 2: fill the weather gaps, join it to the hourly farm table and split the timestamp.

    Zero fill (B9), exact-median fill (D9), regression fill of gusts (H2), kNN fill of pressure on scaled
    features (E8, H3), duplicate hours removed on both sides (E6, E7), left join (C1), ±1-year patch and
    complete rows only (C5, B10), calendar parts (B7).

    ``refit=False`` fits the kNN scaler once on all rows and reuses it (T9); ``refit=True`` reproduces the
    reference: training rows scaled over the rows with a target, rows to fill scaled over all rows.
    """
    # one row per hour first: the neighbour step below keys its rows by the hour
    w = J.dedupe_keep_first(weather, [ts], [c for c in weather.columns if c != ts])
    w = R.fill_constant(w, list(zero_fill), 0.0)
    w = I.fill_median(w, list(median_fill))
    w = I.impute_by_regression(w, gust, speed, digits=2).cache()  # scaler fits, kNN sides and the join read it
    feats = list(knn_features or [c for c in w.columns if c not in (ts, knn_target) and dict(w.dtypes)[c] == "double"])
    base = w.select(ts, knn_target, *feats)

    def as_vectors(df: DataFrame) -> DataFrame:
        v = df.select(F.col(ts).alias("__k"), F.array(*[F.col(c) for c in feats]).alias("__f"),
                      F.col(knn_target).alias("__t"))
        # row id for the neighbour tie-break: the hour number (unique per row, reproducible anywhere)
        return v.withColumn("__id", F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                                     F.col("__k")))

    all_stats = tsx.zscore_fit(base, feats)
    train_stats = tsx.zscore_fit(base, feats, F.col(knn_target).isNotNull()) if refit else all_stats
    train = as_vectors(tsx.zscore(base.filter(F.col(knn_target).isNotNull()), feats, stats=train_stats, centre_constant=True))
    need = as_vectors(tsx.zscore(base.filter(F.col(knn_target).isNull()), feats, stats=all_stats, centre_constant=True))
    vec = as_vectors(base)
    pred = I.knn_predict(train, need, "__id", "__f", "__t", k)
    ids = vec.select("__id", "__k").join(pred, on="__id").select(F.col("__k").alias(ts), "prediction")
    w = w.join(ids, on=ts, how="left").withColumn(
        knn_target, F.coalesce(F.col(knn_target), F.bround("prediction", 2))).drop("prediction")
    h = J.dedupe_keep_max(hourly, [ts], power)
    joined = cut_lineage(J.join_weather(h, w, ts))  # the ±1-year patch reads it several times
    weather_cols = [c for c in w.columns if c != ts and c in joined.columns and dict(joined.dtypes)[c] == "double"]
    final = I.patch_from_year(joined, weather_cols, ts=ts)
    final = R.complete_rows(final)
    return split_timestamp(final, ts, parts=("year", "month", "day", "hour"))


def season_regression(hourly: DataFrame, target: str, speed: str, features: Sequence[str], seasons: Sequence[str],
                      evaluate: Sequence[str] = (), month: str = "filename", ts: str = "ts",
                      models: dict[str, dict] | None = None) -> DataFrame:
    """Entry 4: static regression of ``target`` on the rows of the ``seasons`` months, and its evaluation on others.

    Season rows (E15) -> features by correlation (D19; all others where none passes) -> split inside target quantiles (H1) ->
    scaling learned from the training rows (E8) -> each of ``models`` (name -> parameters of its fitter) fitted once ->
    metrics (H13) on the training rows, the held-out rows and each month of ``evaluate``: ``(model, part, metrics...)``.
    """
    models = models if models is not None else {"rf": {"num_trees": 500}, "rbf": {}, "random_layer": {}}
    known = [c for c in features if c != target]
    season = R.pick_groups(hourly, month, seasons)
    chosen = ST.select_by_correlation(season, target, speed, [target, *known], key=[ts])
    cols = [c for c in known if c in chosen] or known
    sp = M.stratified_split(season.select(month, ts, target, *cols), target, keys=[ts]).drop("stratum")
    rows = sp.withColumnRenamed("split", "part")
    if evaluate:
        other = R.pick_groups(hourly, month, evaluate).select(month, ts, target, *cols)
        rows = rows.unionByName(other.withColumn("part", F.col(month)))
    rows = cut_lineage(rows)  # the scaler, every fit and every scoring read it
    scaled = tsx.zscore(rows, cols, F.col("part") == "train", centre_constant=True)
    train = scaled.filter(F.col("part") == "train")
    out = []
    for name, params in models.items():
        fitted = M.FITTERS[name](train, cols, target, **params)
        out.append(EV.regression_metrics(fitted.predict(scaled), target, "prediction", by=["part"])
                   .select(F.lit(name).alias("model"), "*"))
    return R.union_all(out)
