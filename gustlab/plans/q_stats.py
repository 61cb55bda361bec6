"""Registered queries: statistics and ordered-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustlab.operators import evaluate as ev
from gustlab.operators import impute as I
from gustlab.operators import stats as ST
from gustlab.operators import timeseries as tsx
from gustlab.plans import standins as S
from gustlab.plans.catalog import HOURLY_SQL, METRIC_COLS, _METRICS_SQL, present, register, round_sql

FEATS = S.SCADA_FEATURES
HOURLY = HOURLY_SQL.replace("{agg}", "max")
OTHERS = [c for c in FEATS if c != "active_power_kw"]


def _hourly(spark, d):
    return tsx.hourly_farm(S.scada_10min(spark, d), FEATS, turbines=S.TURBINES)


def _l(fmt, cols=FEATS, sep=", "):
    return sep.join(fmt.format(c=c) for c in cols)


# ------------------------------------------------------------------------------------------- D10
@register("column_summary", round_sql(f"""
    WITH h AS ({HOURLY}), u AS (UNPIVOT h ON {_l("{c}")} INTO NAME feature VALUE v)
    SELECT feature, count(v) AS n, avg(v) AS mean, sum(v) AS sum, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max
    FROM u GROUP BY feature
""", ["mean", "sum", "sd", "min", "max"], 6))
def q_column_summary(spark, d):
    """Count, mean, sum, sd, min, max per hourly feature."""
    return present(ST.column_summary(_hourly(spark, d), FEATS), 6)


# ------------------------------------------------------------------------------------------- D12
@register("decile_calibration", round_sql(f"""
    WITH w AS ({S.WEATHER_HOURLY_SQL}),
    f AS (SELECT regr_intercept(wind_gust, wind_speed) AS a, regr_slope(wind_gust, wind_speed) AS b FROM w),
    p AS (SELECT wind_gust AS actual, f.a + f.b * wind_speed AS pred FROM w, f
          WHERE wind_gust IS NOT NULL AND wind_speed IS NOT NULL),
    o AS (SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS i, count(*) OVER () AS n FROM p),
    qs AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS pr),
    h AS (SELECT pr, (n - 1) * pr AS hh, floor((n - 1) * pr) AS lo, least(floor((n - 1) * pr) + 1, n - 1) AS hi
          FROM qs, (SELECT DISTINCT n FROM o)),
    br AS (SELECT pr, olo.pred + (hh - lo) * (ohi.pred - olo.pred) AS q FROM h
           JOIN o olo ON olo.i = h.lo JOIN o ohi ON ohi.i = h.hi)
    SELECT CAST(1 + (SELECT count(*) FROM br WHERE p.pred > br.q) AS INTEGER) AS bucket,
           avg(actual) AS mean_actual, avg(pred) AS mean_predicted, count(*) AS n
    FROM p GROUP BY 1
""", ["mean_actual", "mean_predicted"], 6))
def q_decile_calibration(spark, d):
    """Gust regression predictions binned at their deciles; mean actual vs predicted per bin."""
    w = S.weather_hourly(spark, d)
    a, b = I.fit_line(w, "wind_gust", "wind_speed")
    p = w.filter(F.col("wind_gust").isNotNull() & F.col("wind_speed").isNotNull()).select(
        F.col("wind_gust").alias("actual"), (F.lit(a) + F.lit(b) * F.col("wind_speed")).alias("pred"))
    return present(ST.decile_calibration(p, "actual", "pred"), 6)


# ------------------------------------------------------------------------------------------- E9
@register("average_rank", f"""
    SELECT DISTINCT turbine, blade_angle,
           rank() OVER (PARTITION BY turbine ORDER BY blade_angle)
             + (count(*) OVER (PARTITION BY turbine, blade_angle) - 1) / 2.0 AS rank
    FROM ({S.scada_10min_sql()})
""")
def q_average_rank(spark, d):
    """Average ranks with ties (value counts + bucketed prefix sums, no global window)."""
    return ST.average_rank_table(S.scada_10min(spark, d), "blade_angle", ["turbine"], "rank")


# ------------------------------------------------------------------------------------------- D15
def _rank_sql(col, part):
    return (f"rank() OVER (PARTITION BY {part} ORDER BY {col}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0")


@register("spearman_correlation", round_sql(f"""
    WITH h AS ({HOURLY}),
    u AS (SELECT t, y_var, v FROM (UNPIVOT (SELECT active_power_kw AS t, {_l("{c}", OTHERS)} FROM h)
                                  ON {_l("{c}", OTHERS)} INTO NAME y_var VALUE v)
          WHERE t IS NOT NULL AND v IS NOT NULL),
    r AS (SELECT y_var, v, t, {_rank_sql('v', 'y_var')} AS rv, {_rank_sql('t', 'y_var')} AS rt FROM u)
    SELECT 'active_power_kw' AS x_var, y_var, count(*) AS n, corr(rv, rt) AS cor_coef, corr(v, t) AS pearson_r
    FROM r GROUP BY y_var
""", ["cor_coef", "pearson_r"], 9))
def q_spearman_correlation(spark, d):
    """D15 coefficients: each hourly feature against power, Spearman (average ranks) and Pearson."""
    return present(ST.correlate(_hourly(spark, d), "active_power_kw", OTHERS), 9)


@register("correlation_test")
def q_correlation_test(spark, d):
    """Significant correlates of power, |ρ| >= 0 and p < 0.05 from the Pearson test."""
    return ST.correlation_test(_hourly(spark, d), "active_power_kw", OTHERS, min_abs=0.0, max_p=0.05)


# ------------------------------------------------------------------------------------------- D16, D17
_PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]


@register("correlation_matrix_pearson", round_sql(f"""
    WITH h AS (SELECT * FROM ({HOURLY}) WHERE {_l("{c} IS NOT NULL", sep=" AND ")})
    {" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM h" for a, b in _PAIRS)}
""", ["r"], 9))
def q_correlation_matrix_pearson(spark, d):
    """Pearson coefficient for every pair of hourly features (one aggregate)."""
    return present(ST.correlation_matrix(_hourly(spark, d), FEATS, "pearson"), 9)


@register("correlation_matrix_spearman", round_sql(f"""
    WITH h AS (SELECT * FROM ({HOURLY}) WHERE {_l("{c} IS NOT NULL", sep=" AND ")}),
    r AS (SELECT {_l("rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}")} FROM h)
    {" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM r" for a, b in _PAIRS)}
""", ["r"], 9))
def q_correlation_matrix_spearman(spark, d):
    """Spearman matrix (columns ranked through one long-form rank table, pivoted back on the hour)."""
    return present(ST.correlation_matrix(_hourly(spark, d), FEATS, "spearman", key=["ts"]), 9)


@register("correlation_pvalues")
def q_correlation_pvalues(spark, d):
    """P-value and 5 % significance flag for every Pearson pair."""
    return ST.correlation_pvalues(ST.correlation_matrix(_hourly(spark, d), FEATS, "pearson"))


# the 97.5 % point of t for v degrees of freedom, by the expansion around the normal point (exact to 1e-6 from v = 30 on)
_T975 = ("(z + (z*z*z + z) / (4*v) + (5*pow(z,5) + 16*z*z*z + 3*z) / (96*v*v)"
         " + (3*pow(z,7) + 19*pow(z,5) + 17*z*z*z - 15*z) / (384*v*v*v))")


@register("correlation_significance", f"""
    WITH h AS (SELECT * FROM ({HOURLY}) WHERE {_l("{c} IS NOT NULL", sep=" AND ")}),
    m AS ({" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM h" for a, b in _PAIRS)}),
    t AS (SELECT *, 1.959963984540054::DOUBLE AS z, (n - 2)::DOUBLE AS v FROM m)
    SELECT x, y, n, abs(r) * sqrt(v / (1 - r * r)) > {_T975} AS significant FROM t
""")
def q_correlation_significance(spark, d):
    """Which Pearson pairs of hourly features are significant at 5 %."""
    return ST.correlation_pvalues(ST.correlation_matrix(_hourly(spark, d), FEATS, "pearson")).select("x", "y", "n", "significant")


@register("significant_correlates", round_sql(f"""
    WITH h AS ({HOURLY}),
    u AS (SELECT t, y_var, v FROM (UNPIVOT (SELECT active_power_kw AS t, {_l("{c}", OTHERS)} FROM h)
                                  ON {_l("{c}", OTHERS)} INTO NAME y_var VALUE v)
          WHERE t IS NOT NULL AND v IS NOT NULL),
    r AS (SELECT y_var, v, t, {_rank_sql('v', 'y_var')} AS rv, {_rank_sql('t', 'y_var')} AS rt FROM u),
    c AS (SELECT y_var, count(*) AS n, corr(rv, rt) AS cor_coef, corr(v, t) AS r,
                 1.959963984540054::DOUBLE AS z, (count(*) - 2)::DOUBLE AS v FROM r GROUP BY y_var)
    SELECT 'active_power_kw' AS x_var, y_var, n, cor_coef FROM c
    WHERE abs(r) * sqrt(v / (1 - r * r)) > {_T975} AND abs(cor_coef) >= 0.02
""", ["cor_coef"], 9))
def q_significant_correlates(spark, d):
    """Correlates of power with |ρ| >= 0.02 and p < 0.05 from the Pearson test."""
    c = ST.correlation_test(_hourly(spark, d), "active_power_kw", OTHERS, min_abs=0.02, max_p=0.05)
    return present(c.select("x_var", "y_var", "n", "cor_coef"), 9)


# ------------------------------------------------------------------------------------------- D18, D19
def _greedy_sql(pairs: str, names: str, cutoff: float) -> str:
    """CTEs up to ``g``, whose last row's ``dropped`` is the greedy pick; ``pairs`` gives (x, y, r), ``names`` (name, idx)."""
    mean = ("list_avg(list_transform(list_filter({l}, lambda s: NOT list_contains(g.dropped, s.y)), lambda s: s.a))")
    return f"""
    m AS (SELECT x, y, abs(r) AS a FROM ({pairs}) UNION ALL SELECT y, x, abs(r) FROM ({pairs})),
    o AS (SELECT x AS name, list({{'y': y, 'a': a}}) AS l, row_number() OVER (ORDER BY avg(a) DESC, min(idx)) AS k
          FROM m JOIN ({names}) n ON n.name = m.x GROUP BY x),
    p AS (SELECT row_number() OVER (ORDER BY i.k, j.k) AS step, i.name AS i, j.name AS j, i.l AS li, j.l AS lj, m.a AS a
          FROM o i JOIN o j ON i.k < j.k JOIN m ON m.x = i.name AND m.y = j.name),
    g AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS dropped
          UNION ALL SELECT p.step, CASE WHEN list_contains(g.dropped, p.i) OR list_contains(g.dropped, p.j) OR p.a <= {cutoff} THEN g.dropped
              WHEN {mean.format(l='p.li')} > {mean.format(l='p.lj')} THEN list_append(g.dropped, p.i) ELSE list_append(g.dropped, p.j) END
          FROM g JOIN p ON p.step = g.step + 1)"""


def _spearman_pairs(names) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM r" for i, a in enumerate(names) for b in names[i + 1:])


_RANKS = f"""h AS (SELECT * FROM ({HOURLY}) WHERE {_l("{c} IS NOT NULL", sep=" AND ")}),
    r AS (SELECT {_l("rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}")} FROM h)"""


def _pruned_at(cutoff: float) -> str:
    names = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS idx" for i, c in enumerate(OTHERS))
    return f"""
    WITH RECURSIVE {_RANKS}, {_greedy_sql(_spearman_pairs(OTHERS), names, cutoff)}
    SELECT unnest(dropped) AS feature FROM g WHERE step = (SELECT max(step) FROM g)"""


@register("prune_correlated_strict", _pruned_at(0.05))
def q_prune_correlated_strict(spark, d):
    """Hourly features to drop so no kept pair has |Spearman ρ| above 0.05."""
    drop = ST.prune_correlated(_hourly(spark, d), OTHERS, 0.05, "spearman", key=["ts"])
    return spark.createDataFrame([(c,) for c in drop], "feature string")


@register("prune_correlated", _pruned_at(0.75))
def q_prune_correlated(spark, d):
    """Hourly features to drop so no kept pair has |Spearman ρ| above 0.75."""
    drop = ST.prune_correlated(_hourly(spark, d), OTHERS, 0.75, "spearman", key=["ts"])
    return spark.createDataFrame([(c,) for c in drop], "feature string")


def _against(target: str) -> str:
    """(y_var, n, coefficient, Pearson r) of the features against a target, and the point its t is held against."""
    others = [c for c in FEATS if c not in ("active_power_kw", "wind_speed_ms")]
    one = "SELECT '{c}' AS y_var, count(*) AS n, corr(r.{c}, r.{t}) AS coef, corr(h.{c}, h.{t}) AS r FROM h JOIN r USING (ts)"
    return (f"SELECT *, 1.959963984540054::DOUBLE AS z, (n - 2)::DOUBLE AS v FROM ("
            + " UNION ALL ".join(one.format(c=c, t=target) for c in others) + ")")


_OWN = [c for c in FEATS if c not in ("active_power_kw", "wind_speed_ms")]


@register("select_by_correlation", f"""
    WITH RECURSIVE {_RANKS.replace("r AS (SELECT ", "r AS (SELECT ts, ")},
    speed AS (SELECT y_var FROM ({_against("wind_speed_ms")}) WHERE abs(r) * sqrt(v / (1 - r * r)) > {_T975} AND abs(coef) >= 0.7),
    kept AS (SELECT y_var AS name, row_number() OVER (ORDER BY abs(coef) DESC) AS idx FROM ({_against("active_power_kw")})
             WHERE abs(r) * sqrt(v / (1 - r * r)) > {_T975} AND y_var NOT IN (SELECT y_var FROM speed)),
    {_greedy_sql(f"SELECT * FROM ({_spearman_pairs(_OWN)}) WHERE x IN (SELECT name FROM kept) AND y IN (SELECT name FROM kept)",
                 "SELECT * FROM kept", 0.75)}
    SELECT name AS feature FROM kept WHERE NOT list_contains((SELECT dropped FROM g WHERE step = (SELECT max(step) FROM g)), name)
""")
def q_select_by_correlation(spark, d):
    """The reference's three-step feature selection on the hourly farm table."""
    keep = ST.select_by_correlation(_hourly(spark, d), "active_power_kw", "wind_speed_ms", FEATS, key=["ts"])
    return spark.createDataFrame([(c,) for c in keep], "feature string")


# ------------------------------------------------------------------------------------------- E8
@register("zscore_features", round_sql(f"""
    WITH h AS ({HOURLY})
    SELECT ts, active_power_kw,
           {_l("({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}", OTHERS)}
    FROM h
""", OTHERS, 9))
def q_zscore_features(spark, d):
    """Predictors centred and scaled (sample sd) over all rows; timestamp and target kept as they are."""
    return present(tsx.zscore(_hourly(spark, d), OTHERS), 9, OTHERS)


# ------------------------------------------------------------------------------------------- E10, E11, E12
ACF_SQL = f"""
    WITH s AS (SELECT revenue AS x, row_number() OVER (ORDER BY ts) - 1 AS i FROM ({S.FARM_SERIES_SQL})),
    st AS (SELECT avg(x) AS m, count(*) AS n FROM s),
    d AS (SELECT i, x - st.m AS d FROM s, st),
    den AS (SELECT sum(d * d) AS den FROM d),
    lags AS (SELECT range AS lag FROM range(0, 31)),
    num AS (SELECT lags.lag, sum(a.d * b.d) AS num FROM lags, d a JOIN d b ON true
            WHERE b.i = a.i + lags.lag GROUP BY lags.lag)
    SELECT CAST(lag AS BIGINT) AS lag, num / den AS acf, 1.959963984540054 / sqrt(n) AS ci,
           abs(num / den) > 1.959963984540054 / sqrt(n) AS significant, n
    FROM num, den, st
"""


@register("acf_revenue", round_sql(ACF_SQL, ["acf", "ci"], 9))
def q_acf_revenue(spark, d):
    """E10 + E11: autocorrelation of daily order revenue for lags 0..30 with the 95 % band."""
    return present(tsx.acf(S.farm_series(spark, d), "revenue", 30), 9)


# the chi-square tail of an even number of degrees of freedom has a closed form
@register("ljung_box", f"""
    WITH a AS ({ACF_SQL.replace("range(0, 31)", "range(0, 11)")}),
    q AS (SELECT CAST(max(n) AS DOUBLE) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM a WHERE lag BETWEEN 1 AND 10)
    SELECT round_even(q, 6) AS q_stat, CAST(10 AS DOUBLE) AS df,
           round_even(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 9) AS p_value FROM q
""")
def q_ljung_box(spark, d):
    """Ljung–Box Q over 10 lags of the daily revenue series, chi-square p-value."""
    lb = tsx.ljung_box(tsx.acf(S.farm_series(spark, d), "revenue", 10), 10)
    return present(present(lb, 6, ["q_stat"]), 9, ["p_value"])


# ------------------------------------------------------------------------------------------- E13
@register("temporal_split", f"""
    WITH h AS ({HOURLY}),
    b AS (SELECT TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR AS t)
    SELECT h.*, CASE
      WHEN h.ts >= b.t - INTERVAL 7 DAY AND h.ts < b.t - INTERVAL 1 DAY + INTERVAL 1 HOUR THEN 'train'
      WHEN h.ts >= b.t - INTERVAL 1 DAY + INTERVAL 1 HOUR AND h.ts < b.t THEN 'validation'
      WHEN h.ts >= b.t AND h.ts <= b.t + INTERVAL 1 DAY + INTERVAL 1 HOUR THEN 'test' END AS split
    FROM h, b
""")
def q_temporal_split(spark, d):
    """Train 7 days, validation 1 day, test 1 day around 20 Jan, 1-hour horizon."""
    return tsx.temporal_split(_hourly(spark, d), "2024-01-20 00:00:00", train_days=7, test_days=1, val_days=1)


# ------------------------------------------------------------------------------------------- E14
@register("sequence_windows", f"""
    WITH h AS ({HOURLY})
    SELECT ts, {_l("lag(active_power_kw, {c}) OVER (ORDER BY ts) AS power_lag{c}", [0, 1, 2])},
           {_l("lag(wind_speed_ms, {c}) OVER (ORDER BY ts) AS wind_lag{c}", [0, 1, 2])}
    FROM h
""")
def q_sequence_windows(spark, d):
    """Each hour's last 3 hours of (power, wind) as a sequence, shown flattened by lag."""
    seq = tsx.sequence_windows(_hourly(spark, d), ["active_power_kw", "wind_speed_ms"], 3)
    cols = []
    for j in range(3):
        step = F.try_element_at("seq", F.lit(-(j + 1)))
        cols.append(F.try_element_at(step, F.lit(1)).alias(f"power_lag{j}"))
        cols.append(F.try_element_at(step, F.lit(2)).alias(f"wind_lag{j}"))
    return seq.select("ts", *cols)


# ------------------------------------------------------------------------------------------- E4 reference mode
@register("persistence_metrics_reference_mode", round_sql(f"""
    WITH s AS ({S.scada_10min_sql()}),
    t AS (SELECT turbine, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(active_power_kw) AS p FROM s GROUP BY 1, 2),
    h AS (SELECT ts, round_even(max(p), 3) AS act FROM t GROUP BY ts),
    l AS (SELECT ts, act, coalesce(lead(act, 1) OVER w, first_value(act) OVER w) AS lead1 FROM h
          WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    f AS (SELECT act, lag(0.0 + lead1, 1) OVER (ORDER BY ts) AS pred FROM l)
    SELECT {_METRICS_SQL} FROM f WHERE pred IS NOT NULL
""", METRIC_COLS, 6))
def q_persistence_metrics_reference_mode(spark, d):
    """E4 with the reference's restoration (T12): pred(t-1) + lead(t-1) equals the actual, so a zero model scores 0."""
    hourly = tsx.hourly_farm(S.scada_10min(spark, d), ["active_power_kw"], turbines=S.TURBINES)
    diffed = tsx.difference(hourly, "active_power_kw", k=1, lead_col="power_lead", diff_col="power_diff")
    fc = diffed.withColumn("pred_diff", F.lit(0.0))
    scored = tsx.undifference(fc, "pred_diff", "active_power_kw", "power_lead", k=1, mode="reference")
    return present(ev.regression_metrics(scored, "active_power_kw", "predicted_power"), 6)


# ------------------------------------------------------------------------------------------- entries 1, 2
@register("hourly_sensor_workflow")
def q_hourly_sensor_workflow(spark, d):
    """Entry 1: donor fills, zero-variance drop, hourly farm max, correlation selection on the turbine feed."""
    from gustlab.plans.workflows import sensor_to_hourly

    out, _ = sensor_to_hourly(S.scada_10min(spark, d, with_nulls=True), FEATS, "active_power_kw", "wind_speed_ms",
                              turbines=S.TURBINES)
    return out


def _med(src: str, c: str) -> str:
    return f"""(SELECT avg({c}) FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i,
                                           count(*) OVER () AS n FROM {src} WHERE {c} IS NOT NULL)
               WHERE i = floor((n - 1) / 2) OR i = floor(n / 2))"""


_WF = S.WEATHER_FEATURES
_KNN_F = [c for c in _WF if c != "pressure"]
_ALL_FINAL = ["ts"] + FEATS + _WF
FINAL_WEATHER_SQL = f"""
    WITH wr AS (SELECT ts, {_l("{c}", _WF)} FROM ({S.WEATHER_HOURLY_SQL})),
    w1 AS (SELECT * REPLACE (coalesce(precip_intensity, 0.0) AS precip_intensity,
                             coalesce(precip_probability, 0.0) AS precip_probability) FROM wr),
    w2 AS (SELECT * REPLACE (coalesce(wind_speed, {_med("w1", "wind_speed")}) AS wind_speed,
                             coalesce(wind_bearing, {_med("w1", "wind_bearing")}) AS wind_bearing,
                             coalesce(visibility, {_med("w1", "visibility")}) AS visibility) FROM w1),
    f AS (SELECT regr_intercept(wind_gust, wind_speed) AS a, regr_slope(wind_gust, wind_speed) AS b FROM w2),
    w3 AS (SELECT w2.* REPLACE (CASE WHEN wind_gust IS NULL THEN round_even(f.a + f.b * wind_speed, 2)
                                     ELSE wind_gust END AS wind_gust) FROM w2, f),
    st AS (SELECT {_l("avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}", _KNN_F)} FROM w3),
    sc AS (SELECT ts, pressure, date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', ts) AS id,
                  [{_l("({c} - m_{c}) / s_{c}", _KNN_F)}]::DOUBLE[] AS fv FROM w3, st),
    q AS (SELECT * FROM sc WHERE pressure IS NULL), t AS (SELECT * FROM sc WHERE pressure IS NOT NULL),
    pairs AS (SELECT q.ts AS qts, t.id AS tid, t.pressure AS y, list_distance(q.fv, t.fv) AS d FROM q, t),
    top AS (SELECT qts, y, row_number() OVER (PARTITION BY qts ORDER BY d, tid) AS rn FROM pairs),
    pred AS (SELECT qts, avg(y) AS p FROM top WHERE rn <= 5 GROUP BY qts),
    w4 AS (SELECT w3.* REPLACE (coalesce(w3.pressure, round_even(pred.p, 2)) AS pressure)
           FROM w3 LEFT JOIN pred ON w3.ts = pred.qts),
    h AS ({HOURLY}),
    j AS (SELECT h.*, {_l("w4.{c}", _WF)} FROM h LEFT JOIN w4 ON h.ts = w4.ts),
    ok AS (SELECT * FROM j WHERE {_l("{c} IS NOT NULL", _WF, " AND ")}),
    p1 AS (SELECT ts - INTERVAL 1 YEAR AS pts, {_l("{c} AS a_{c}", _WF)},
                  row_number() OVER (PARTITION BY ts - INTERVAL 1 YEAR ORDER BY {_l("{c}", _WF)}) AS rn FROM ok),
    p2 AS (SELECT ts + INTERVAL 1 YEAR AS pts, {_l("{c} AS b_{c}", _WF)},
                  row_number() OVER (PARTITION BY ts + INTERVAL 1 YEAR ORDER BY {_l("{c}", _WF)}) AS rn FROM ok),
    need AS (SELECT j.* REPLACE ({_l("coalesce(j.{c}, p1.a_{c}, p2.b_{c}) AS {c}", _WF)})
             FROM j LEFT JOIN (SELECT * FROM p1 WHERE rn = 1) p1 ON j.ts = p1.pts
                    LEFT JOIN (SELECT * FROM p2 WHERE rn = 1) p2 ON j.ts = p2.pts
             WHERE {_l("j.{c} IS NULL", _WF, " OR ")}),
    fin AS (SELECT * FROM ok UNION ALL SELECT * FROM need)
    SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour
    FROM fin WHERE {_l("{c} IS NOT NULL", _ALL_FINAL, " AND ")}
"""


@register("final_weather_table", FINAL_WEATHER_SQL)
def q_final_weather_table(spark, d):
    """Entry 2: weather gaps filled (zero, median, regression, kNN), joined to the hourly farm table, patched."""
    from gustlab.plans.workflows import weather_to_final

    return weather_to_final(_hourly(spark, d), S.weather_hourly(spark, d).drop("month_label"), "active_power_kw")


@register("ljung_box_q", round_sql(f"""
    WITH a AS ({ACF_SQL.replace("range(0, 31)", "range(0, 11)")})
    SELECT CAST(max(n) AS DOUBLE) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q_stat, CAST(10 AS DOUBLE) AS df
    FROM a WHERE lag BETWEEN 1 AND 10
""", ["q_stat"], 6))
def q_ljung_box_q(spark, d):
    """E12 statistic: Ljung–Box Q over 10 lags of the daily revenue series and its degrees of freedom."""
    lb = tsx.ljung_box(tsx.acf(S.farm_series(spark, d), "revenue", 10), 10)
    return present(lb.select("q_stat", "df"), 6, ["q_stat"])
