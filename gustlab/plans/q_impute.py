"""Registered queries: filling missing values (B9 median, C2-C5, D9, H2, H3)."""

from __future__ import annotations

from pyspark.sql import functions as F


from gustlab.operators import impute as I
from gustlab.operators import joins as J
from gustlab.plans import standins as S
from gustlab.plans.catalog import METRIC_COLS, _METRICS_SQL, present, register, round_sql

DAILY = S.daily_orders_sql()
DFEATS = ["revenue", "n_orders", "avg_price"]
ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in DFEATS)
ANY_NULL = " OR ".join(f"{c} IS NULL" for c in DFEATS)


# ------------------------------------------------------------------------------------------- C2
@register("impute_from_donor", f"""
    WITH d AS ({DAILY}),
    inc AS (SELECT * FROM d WHERE {ANY_NULL}),
    ok AS (SELECT * FROM d WHERE {ALL_PRESENT}),
    don AS (SELECT series, ts, revenue, n_orders, avg_price FROM (
              SELECT series, ts + INTERVAL 1 YEAR AS ts, revenue, n_orders, avg_price,
                     row_number() OVER (PARTITION BY series, ts + INTERVAL 1 YEAR
                                        ORDER BY revenue, n_orders, avg_price) AS rn
              FROM d WHERE {ALL_PRESENT}) WHERE rn = 1),
    filled AS (SELECT inc.filename, inc.series, inc.ts, don.revenue, don.n_orders, don.avg_price
               FROM inc LEFT JOIN don ON inc.series = don.series AND inc.ts = don.ts),
    u AS (SELECT * FROM ok UNION ALL SELECT * FROM filled)
    SELECT filename || '_imputed' AS filename, series, ts, revenue, n_orders, avg_price FROM u WHERE {ALL_PRESENT}
""")
def q_impute_from_donor(spark, d):
    """Incomplete day rows take the same series' day of the previous year (row mode); rest dropped."""
    df = S.daily_orders(spark, d)
    return I.impute_from_donor(df, df, ["series"], DFEATS, donor_years=1, mode="row")


@register("impute_from_donor_cells", f"""
    WITH d AS ({DAILY}),
    inc AS (SELECT * FROM d WHERE {ANY_NULL}),
    ok AS (SELECT * FROM d WHERE {ALL_PRESENT}),
    don AS (SELECT * FROM (
              SELECT series, ts + INTERVAL 1 YEAR AS ts, revenue, n_orders, avg_price,
                     row_number() OVER (PARTITION BY series, ts + INTERVAL 1 YEAR
                                        ORDER BY revenue NULLS FIRST, n_orders NULLS FIRST, avg_price NULLS FIRST) AS rn
              FROM d) WHERE rn = 1),
    filled AS (SELECT inc.filename, inc.series, inc.ts, coalesce(inc.revenue, don.revenue) AS revenue,
                      coalesce(inc.n_orders, don.n_orders) AS n_orders, coalesce(inc.avg_price, don.avg_price) AS avg_price
               FROM inc LEFT JOIN don ON inc.series = don.series AND inc.ts = don.ts),
    u AS (SELECT * FROM ok UNION ALL SELECT * FROM filled)
    SELECT filename || '_imputed' AS filename, series, ts, revenue, n_orders, avg_price FROM u WHERE {ALL_PRESENT}
""")
def q_impute_from_donor_cells(spark, d):
    """C2 cell mode: only the NULL cells take the donor's values."""
    df = S.daily_orders(spark, d)
    return I.impute_from_donor(df, df, ["series"], DFEATS, donor_years=1, mode="cell")


# ------------------------------------------------------------------------------------------- C3, C4
@register("missing_periods", f"""
    WITH d AS ({DAILY}), s AS (SELECT DISTINCT series, ts + INTERVAL 1 YEAR AS ts FROM d)
    SELECT s.series, s.ts FROM s ANTI JOIN d ON s.series = d.series AND s.ts = d.ts
""")
def q_missing_periods(spark, d):
    """(series, day) slots one year on that the data lacks."""
    df = S.daily_orders(spark, d)
    return I.missing_periods(df, df, ["series"], years=1)


@register("backfill_missing_periods", f"""
    WITH d AS ({DAILY}),
    m AS (SELECT a.series, a.ts + INTERVAL 1 YEAR AS ts, a.revenue, a.n_orders, a.avg_price FROM d a
          ANTI JOIN d b ON b.series = a.series AND b.ts = a.ts + INTERVAL 1 YEAR)
    SELECT strftime(ts, '%b%Y') AS filename, series, ts, revenue, n_orders, avg_price FROM (
      SELECT series, ts, revenue, n_orders, avg_price FROM d UNION ALL SELECT * FROM m)
""")
def q_backfill_missing_periods(spark, d):
    """C4: rows whose next-year slot is absent are re-stamped one year on and appended."""
    df = S.daily_orders(spark, d)
    out = I.backfill_missing_periods(df.drop("filename"), df.drop("filename"), ["series"], years=1)
    return out.select(F.date_format("ts", "MMMyyyy").alias("filename"), "series", "ts", *DFEATS)


# ------------------------------------------------------------------------------------------- C5
_JOINED = f"""SELECT o.ts, o.revenue, o.n_orders, o.avg_price, s.ship_qty, s.ship_discount
              FROM ({S.FARM_SERIES_SQL}) o LEFT JOIN ({S.DAILY_SHIPMENTS_SQL}) s ON o.ts = s.ts"""


@register("patch_from_year", f"""
    WITH j AS ({_JOINED}),
    ok AS (SELECT * FROM j WHERE ship_qty IS NOT NULL AND ship_discount IS NOT NULL),
    p1 AS (SELECT * FROM (SELECT ts - INTERVAL 1 YEAR AS ts, ship_qty AS q1, ship_discount AS d1,
             row_number() OVER (PARTITION BY ts - INTERVAL 1 YEAR ORDER BY ship_qty, ship_discount) AS rn FROM ok)
           WHERE rn = 1),
    p2 AS (SELECT * FROM (SELECT ts + INTERVAL 1 YEAR AS ts, ship_qty AS q2, ship_discount AS d2,
             row_number() OVER (PARTITION BY ts + INTERVAL 1 YEAR ORDER BY ship_qty, ship_discount) AS rn FROM ok)
           WHERE rn = 1),
    need AS (SELECT j.ts, j.revenue, j.n_orders, j.avg_price,
                    coalesce(j.ship_qty, p1.q1, p2.q2) AS ship_qty, coalesce(j.ship_discount, p1.d1, p2.d2) AS ship_discount
             FROM j LEFT JOIN p1 ON j.ts = p1.ts LEFT JOIN p2 ON j.ts = p2.ts
             WHERE j.ship_qty IS NULL OR j.ship_discount IS NULL)
    SELECT * FROM (SELECT * FROM ok UNION ALL SELECT * FROM need) WHERE ship_qty IS NOT NULL AND ship_discount IS NOT NULL
""")
def q_patch_from_year(spark, d):
    """C1 + C5: daily orders left-joined with shipments; days without shipments take them from ±1 year."""
    j = J.join_weather(S.farm_series(spark, d), S.daily_shipments(spark, d))
    return I.patch_from_year(j, ["ship_qty", "ship_discount"], years=(1, -1))


# ------------------------------------------------------------------------------------------- D9, B9
_W = S.WEATHER_HOURLY_SQL
MED_COLS = ["wind_speed", "wind_bearing", "visibility"]


def _median_sql(c: str) -> str:
    return f"""(SELECT avg({c}) FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i,
                                           count(*) OVER () AS n FROM w WHERE {c} IS NOT NULL)
               WHERE i = floor((n - 1) / 2) OR i = floor(n / 2))"""


@register("fill_median", f"""
    WITH w AS ({_W})
    SELECT month_label, ts, precip_intensity, precip_probability, temperature, apparent_temperature, dew_point,
           humidity, pressure, coalesce(wind_speed, {_median_sql('wind_speed')}) AS wind_speed, wind_gust,
           coalesce(wind_bearing, {_median_sql('wind_bearing')}) AS wind_bearing,
           coalesce(visibility, {_median_sql('visibility')}) AS visibility
    FROM w
""")
def q_fill_median(spark, d):
    """D9 + B9: wind speed, bearing and visibility NULLs take the exact column median."""
    return I.fill_median(S.weather_hourly(spark, d), MED_COLS)


@register("column_medians", f"""
    WITH w AS ({_W})
    SELECT * FROM (VALUES ('wind_speed', {_median_sql('wind_speed')}), ('wind_bearing', {_median_sql('wind_bearing')}),
                          ('visibility', {_median_sql('visibility')})) t(__var, median)
""")
def q_column_medians(spark, d):
    """Exact medians through the distributed position index (no single-task sort)."""
    return I.median_values(S.weather_hourly(spark, d), MED_COLS)


# ------------------------------------------------------------------------------------------- H2
def _hour_no():
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))


def _gust_split(spark, d):
    """70 % split of the hours with a gust, inside 4 quantile bins of the gust (H1); reproducible order."""
    from gustlab.operators import models as M

    w = S.weather_hourly(spark, d).filter(F.col("wind_gust").isNotNull() & F.col("wind_speed").isNotNull())
    key = ((_hour_no() % 1000003) * 48271 + 123) % 2147483647
    return M.stratified_split(w, "wind_gust", keys=["ts"], shuffle_key=key, tiebreak=["ts"])


def _q_sql(col, p):
    return f"""(SELECT olo.{col} + ((n - 1) * {p} - floor((n - 1) * {p})) * (ohi.{col} - olo.{col})
              FROM o olo, o ohi, (SELECT count(*) AS n FROM o)
              WHERE olo.i = floor((n - 1) * {p}) AND ohi.i = least(floor((n - 1) * {p}) + 1, n - 1))"""


GUST_TRAIN_SQL = f"""
    g AS (SELECT * FROM w WHERE wind_gust IS NOT NULL AND wind_speed IS NOT NULL),
    o AS (SELECT wind_gust, row_number() OVER (ORDER BY wind_gust) - 1 AS i FROM g),
    b AS (SELECT g.*, 1 + (CASE WHEN wind_gust > {_q_sql('wind_gust', 0.25)} THEN 1 ELSE 0 END)
                        + (CASE WHEN wind_gust > {_q_sql('wind_gust', 0.5)} THEN 1 ELSE 0 END)
                        + (CASE WHEN wind_gust > {_q_sql('wind_gust', 0.75)} THEN 1 ELSE 0 END) AS stratum,
                 ((date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', ts) % 1000003) * 48271 + 123) % 2147483647 AS sk
          FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sk, ts) - 1 AS pos,
                 count(*) OVER (PARTITION BY stratum) AS n FROM b),
    tr AS (SELECT * FROM r WHERE pos < ceil(n * 0.7))
"""


@register("impute_gust_regression", f"""
    WITH w AS ({_W}), {GUST_TRAIN_SQL},
    f AS (SELECT regr_intercept(wind_gust, wind_speed) AS a, regr_slope(wind_gust, wind_speed) AS b FROM tr)
    SELECT w.ts, w.wind_speed,
           CASE WHEN w.wind_gust IS NULL THEN round_even(f.a + f.b * w.wind_speed, 2) ELSE w.wind_gust END AS wind_gust
    FROM w, f
""")
def q_impute_gust_regression(spark, d):
    """H1 + H2: fit gust ~ speed on the 70 % training split of the complete hours, fill NULL gusts with the
    prediction rounded to 2 places (as the reference trains on its partition)."""
    sp = _gust_split(spark, d)
    train = sp.filter(F.col("split") == "train")
    out = I.impute_by_regression(S.weather_hourly(spark, d), "wind_gust", "wind_speed", digits=2, train=train)
    return out.select("ts", "wind_speed", "wind_gust")


# ------------------------------------------------------------------------------------------- H3
@register("impute_label_knn", f"""
    WITH v AS ({S.VECTORS_SQL}),
    q AS (SELECT * FROM v WHERE label IS NULL), t AS (SELECT * FROM v WHERE label IS NOT NULL),
    pairs AS (SELECT q.vec_id AS qk, t.vec_id AS tk, t.label AS y, list_distance(q.features, t.features) AS d
              FROM q, t),
    top AS (SELECT qk, y, row_number() OVER (PARTITION BY qk ORDER BY d, tk) AS rn FROM pairs),
    pred AS (SELECT qk, avg(y) AS p FROM top WHERE rn <= 5 GROUP BY qk)
    SELECT v.vec_id, coalesce(v.label, round_even(pred.p, 2)) AS label, v.label IS NULL AS imputed
    FROM v LEFT JOIN pred ON v.vec_id = pred.qk
""")
def q_impute_label_knn(spark, d):
    """H3: exact 5-nearest-neighbour mean fills the missing labels (no cross join; see knn_predict)."""
    out = I.impute_by_knn(S.vectors(spark, d), "vec_id", "features", "label", k=5, digits=2)
    return out.select("vec_id", "label", "imputed")





# ------------------------------------------------------------------------------------------- E15
SEASON_MONTHS = ["Jan1998", "Apr1997", "Jul1997", "Oct1998"]


@register("seasonal_months", f"""
    SELECT * FROM ({DAILY}) WHERE filename IN ({", ".join(f"'{m}'" for m in SEASON_MONTHS)})
""")
def q_seasonal_months(spark, d):
    """One month per season picked from the daily series."""
    from gustlab.operators.reshape import pick_groups

    return pick_groups(S.daily_orders(spark, d), "filename", SEASON_MONTHS)


# ------------------------------------------------------------------------------------------- H2 + H13, H3 + H4
@register("gust_regression_error", round_sql(f"""
    WITH w AS ({_W}), {GUST_TRAIN_SQL},
    f AS (SELECT regr_intercept(wind_gust, wind_speed) AS a, regr_slope(wind_gust, wind_speed) AS b FROM tr),
    x AS (SELECT CASE WHEN pos < ceil(n * 0.7) THEN 'train' ELSE 'test' END AS split, wind_gust AS act,
                 f.a + f.b * wind_speed AS pred FROM r, f)
    SELECT split, {_METRICS_SQL} FROM x GROUP BY split
""", METRIC_COLS, 6))
def q_gust_regression_error(spark, d):
    """H2 + H1 + H13: gust ~ speed fitted on a 70 % stratified split; mean error % = RMSE / mean actual, on the
    training residuals (as the reference reports) and on the held-out rows."""
    from gustlab.operators import evaluate as ev

    sp = _gust_split(spark, d).cache()
    a, b = I.fit_line(sp.filter(F.col("split") == "train"), "wind_gust", "wind_speed")
    scored = sp.withColumn("pred", F.lit(a) + F.lit(b) * F.col("wind_speed"))
    return present(ev.regression_metrics(scored, "wind_gust", "pred", by=["split"]), 6)


@register("knn_cv_error", round_sql(f"""
    WITH t AS (SELECT * FROM ({S.VECTORS_SQL}) WHERE label IS NOT NULL),
    f AS (SELECT vec_id, r, CAST((vec_id * 48271 + 123 + r * 7919) % 2147483647 % 10 AS INTEGER) AS fold
          FROM t, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS r)),
    pairs AS (SELECT q.vec_id AS qk, q.label AS act, n.vec_id AS tk, n.label AS y, list_distance(q.features, n.features) AS d
              FROM t q, t n WHERE q.vec_id <> n.vec_id),
    top AS (SELECT a.r, a.fold, qk, act, y, row_number() OVER (PARTITION BY a.r, qk ORDER BY d, tk) AS rn
            FROM pairs JOIN f a ON a.vec_id = qk JOIN f b ON b.vec_id = tk AND b.r = a.r WHERE a.fold <> b.fold),
    x AS (SELECT k, r, fold, qk, act, avg(y) AS pred FROM top, (SELECT CAST(unnest([5, 7, 9]) AS INTEGER) AS k)
          WHERE rn <= k GROUP BY ALL)
    SELECT k, r AS repeat, fold, {_METRICS_SQL} FROM x GROUP BY k, r, fold
""", METRIC_COLS, 6))
def q_knn_cv_error(spark, d):
    """H3 + H4: 10-fold x 3 repeated CV of the exact nearest-neighbour regressor with 5, 7 and 9 neighbours on the labelled
    vectors, in one search; metrics per setting, repeat and fold."""
    fold = lambda r: (F.col("vec_id") * 48271 + 123 + r * 7919) % 2147483647 % 10
    return present(I.knn_cv(S.vectors(spark, d), "vec_id", "features", "label", ks=(5, 7, 9), folds=10, repeats=3, fold_of=fold), 6)


@register("knn_tuned_fill")
def q_knn_tuned_fill(spark, d):
    """H3 + H4 + H14: k chosen from 5, 7, 9 by 10-fold x 3 repeated CV (one pass per query chunk), then the
    missing labels filled with that k; per-k CV summary alongside."""
    from gustlab.operators import evaluate as ev

    v = S.vectors(spark, d).cache()
    cv = I.knn_cv(v, "vec_id", "features", "label", ks=(5, 7, 9), folds=10, repeats=3).cache()
    k = I.best_k(cv)
    filled = I.impute_by_knn(v, "vec_id", "features", "label", k=k).select("vec_id", "label", "imputed")
    summary = ev.cv_summary(cv.withColumn("model", F.concat(F.lit("knn_k"), F.col("k").cast("string"))), "model",
                            ("rmse", "mae"))
    cv_rmse = summary.filter(F.col("model") == F.lit(f"knn_k{k}")).first()["rmse_mean"]  # one number
    return filled.withColumns({"k": F.lit(k), "cv_rmse": F.lit(cv_rmse)})
