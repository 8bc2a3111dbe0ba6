"""Catalogue: aggregations, windows, top-k, set operations and joins (E*, F*, G*, H1, D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import snapshot as snap
from journeyflow.operators import stats as st
from journeyflow.operators.project import with_event_meta, attach_predictions
from journeyflow.plans.common import defs, ev, flat
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.sources.bindings import daily_lines, scores

_DAY = 86400000000.0
_HOUR = 3600000000.0

# journey statistics over a binding, shared by several oracles
_JS = """js AS (
  SELECT id, CAST(count(*) AS BIGINT) AS n_actions, min(us) AS start_us, max(us) AS end_us,
         (max(us) - min(us)) / {h} AS duration_hours, (max(us) - min(us)) / {d} AS duration_days,
         bool_or(ed_id = 28) AS is_success
  FROM {{b}} GROUP BY id)""".format(h=_HOUR, d=_DAY)


@query("e1_log_summary", sql=with_ctes("j1") + """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT id) AS BIGINT) AS n_ids,
       min(event_timestamp) AS min_ts, max(event_timestamp) AS max_ts FROM j1""")
def e1(spark, sf):
    return st.log_summary(ev(spark, sf, "j1"))


@query("e2_journey_stats", sql=with_ctes("j2", extra=_JS.format(b="j2")) + """SELECT id, n_actions, make_timestamp(start_us) AS start_time,
       make_timestamp(end_us) AS end_time, duration_hours, duration_days, is_success FROM js""")
def e2(spark, sf):
    return st.journey_stats(ev(spark, sf, "j2"))


@query("e3_journey_population", sql=with_ctes("j1", extra=_JS.format(b="j1")) + """SELECT CAST(count(*) AS BIGINT) AS n_journeys,
       avg(n_actions) AS mean_actions, CAST(median(n_actions) AS DOUBLE) AS median_actions, max(n_actions) AS max_actions,
       avg(duration_days) AS mean_duration_days, median(duration_days) AS median_duration_days, max(duration_days) AS max_duration_days
FROM js""")
def e3(spark, sf):
    return st.journey_population(st.journey_stats(ev(spark, sf, "j1")))


@query("e4_conversion_rate", sql=with_ctes("j1", extra=_JS.format(b="j1")) + """SELECT CAST(count(*) AS BIGINT) AS n_journeys,
       CAST(count(*) FILTER (WHERE is_success) AS BIGINT) AS n_success, avg(CAST(is_success AS DOUBLE)) AS success_rate FROM js""")
def e4(spark, sf):
    return st.conversion_rate(st.journey_stats(ev(spark, sf, "j1")))


@query("e5_outcome_comparison", sql=with_ctes("j2", extra=_JS.format(b="j2")) + """SELECT is_success, CAST(count(*) AS BIGINT) AS n_journeys,
       CAST(median(n_actions) AS DOUBLE) AS median_actions, avg(n_actions) AS mean_actions,
       median(duration_days) AS median_duration_days, avg(duration_days) AS mean_duration_days
FROM js GROUP BY is_success""")
def e5(spark, sf):
    return st.outcome_comparison(st.journey_stats(ev(spark, sf, "j2")))


@query("e6_event_counts", sql=with_ctes("j1") + "SELECT ed_id, CAST(count(*) AS BIGINT) AS n FROM j1 GROUP BY ed_id")
def e6(spark, sf):
    return st.event_counts(ev(spark, sf, "j1"))


@query("e7_event_shares", sql=with_ctes("j1", "defs") + """, c AS (SELECT ed_id, CAST(count(*) AS BIGINT) AS n FROM j1 GROUP BY ed_id)
SELECT c.ed_id, c.n, c.n / sum(c.n) OVER () AS share, d.event_name, d.stage FROM c LEFT JOIN defs d ON c.ed_id = d.ed_id""")
def e7(spark, sf):
    return st.event_shares(ev(spark, sf, "j1"), defs(spark), "left")


@query("d1_top_events", sql=with_ctes("j2", "defs") + """, c AS (SELECT ed_id, CAST(count(*) AS BIGINT) AS n FROM j2 GROUP BY ed_id),
s AS (SELECT ed_id, n, n / sum(n) OVER () AS share FROM c)
SELECT s.ed_id, s.n, s.share, d.event_name, d.stage FROM s JOIN defs d ON s.ed_id = d.ed_id ORDER BY s.n DESC, s.ed_id LIMIT 10""")
def d1(spark, sf):
    return st.top_events(ev(spark, sf, "j2"), defs(spark), 10, "inner")


@query("d2_event_counts_left_join", sql=with_ctes("j2", "defs") + """, c AS (SELECT ed_id, CAST(count(*) AS BIGINT) AS n FROM j2 GROUP BY ed_id)
SELECT c.ed_id, c.n, c.n / sum(c.n) OVER () AS share, d.event_name, d.stage FROM c LEFT JOIN defs d ON c.ed_id = d.ed_id""")
def d2(spark, sf):
    return st.event_shares(ev(spark, sf, "j2"), defs(spark), "left")


@query("d3_event_meta", sql=with_ctes("j1", "defs") + """SELECT e.id, e.event_timestamp, e.ed_id, d.event_name AS ev_event_name, d.stage AS ev_stage,
       d.milestone_number AS ev_milestone_number FROM j1 e LEFT JOIN defs d ON e.ed_id = d.ed_id""")
def d3(spark, sf):
    return with_event_meta(flat(ev(spark, sf, "j1")), defs(spark), "ed_id", "ev_", ("event_name", "stage", "milestone_number"))


@query("d5_attach_predictions", sql=with_ctes("j2", "m1") + """SELECT j.id, j.n_actions, m1.p FROM (SELECT id, CAST(count(*) AS BIGINT) AS n_actions FROM j2 GROUP BY id) j
JOIN m1 ON j.id = m1.id""")
def d5(spark, sf):
    ids = ev(spark, sf, "j2").groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"))
    return attach_predictions(ids, scores(spark, sf, ("m1",)).select("id", "p"))


_MOM = """, st AS (SELECT id, min(us) AS s FROM {b} GROUP BY id),
mo AS (
  SELECT e.id, CAST(count(*) AS BIGINT) AS n_actions, bool_or(e.ed_id = 28) AS is_success,
         CAST(count(*) FILTER (WHERE (e.us - st.s) // 1000000 <= 3600) AS BIGINT) AS momentum_1h,
         CAST(count(*) FILTER (WHERE (e.us - st.s) // 1000000 <= 18000) AS BIGINT) AS momentum_5h,
         CAST(count(*) FILTER (WHERE (e.us - st.s) // 1000000 <= 86400) AS BIGINT) AS momentum_1d,
         CAST(count(*) FILTER (WHERE (e.us - st.s) // 1000000 <= 259200) AS BIGINT) AS momentum_3d
  FROM {b} e JOIN st ON e.id = st.id GROUP BY e.id)"""


@query("l2_momentum", sql=with_ctes("j1") + _MOM.format(b="j1") + " SELECT * FROM mo")
def l2(spark, sf):
    return st.momentum(ev(spark, sf, "j1"))


@query("e8_momentum_by_outcome", sql=with_ctes("j2") + _MOM.format(b="j2") + """
SELECT is_success, w AS window, mean_events FROM (
  SELECT is_success, avg(momentum_1h) AS "1h", avg(momentum_5h) AS "5h", avg(momentum_1d) AS "1d", avg(momentum_3d) AS "3d"
  FROM mo GROUP BY is_success) UNPIVOT (mean_events FOR w IN ("1h", "5h", "1d", "3d"))""")
def e8(spark, sf):
    return st.momentum_by_outcome(st.momentum(ev(spark, sf, "j2")))


@query("e14_check_invariants", sql=with_ctes("j2") + _MOM.format(b="j2") + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, bool_and(momentum_3d <= n_actions) AS momentum_3d_le_n,
       bool_and(momentum_1h <= momentum_5h AND momentum_5h <= momentum_1d AND momentum_1d <= momentum_3d) AS momentum_monotone,
       avg(CAST(momentum_3d AS DOUBLE)) AS mean_momentum_3d, avg(CAST(n_actions AS DOUBLE)) AS mean_n_actions FROM mo""")
def e14(spark, sf):
    m = st.momentum(ev(spark, sf, "j2"))
    checks = {
        "momentum_3d_le_n": F.col("momentum_3d") <= F.col("n_actions"),
        "momentum_monotone": (F.col("momentum_1h") <= F.col("momentum_5h")) & (F.col("momentum_5h") <= F.col("momentum_1d"))
        & (F.col("momentum_1d") <= F.col("momentum_3d")),
    }
    return st.check_invariants(m, checks, ["momentum_3d", "n_actions"])


def _snap(spark, sf, b):
    return snap.snapshot(ev(spark, sf, b), defs(spark))


_DESC_COLS = ("n_events_observed", "observed_duration_days", "days_since_last_event")


def _describe_sql(b, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, CAST(count({x}) AS BIGINT) AS count, avg({x}) AS mean, stddev_samp({x}) AS std,
       min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75,
       quantile_cont({x}, 0.9) AS p90, max({x}) AS max FROM snap_{b}""")
    return with_ctes(f"snap_{b}") + "\nUNION ALL\n".join(parts)


@query("e9_describe_numeric", sql=_describe_sql("j2", _DESC_COLS))
def e9(spark, sf):
    return st.describe_numeric(_snap(spark, sf, "j2"), _DESC_COLS)


_TOP_COLS = ("first_event_name", "last_stage", "last_event_name")


@query("e10_top_values", sql=with_ctes("snap_j1") + """, kv AS (
""" + "\n  UNION ALL\n".join(f"  SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS value FROM snap_j1" for c in _TOP_COLS) + """),
c AS (SELECT column_name, value, CAST(count(*) AS BIGINT) AS n FROM kv GROUP BY column_name, value)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 10""")
def e10(spark, sf):
    return st.top_values(_snap(spark, sf, "j1"), _TOP_COLS, 10)


@query("e11_value_shares", sql=with_ctes("snap_j1") + """, c AS (SELECT coalesce(last_stage, 'MISSING') AS value, CAST(count(*) AS BIGINT) AS n FROM snap_j1 GROUP BY 1)
SELECT value, n, n * 100.0 / sum(n) OVER () AS pct FROM c""")
def e11(spark, sf):
    return st.value_shares(_snap(spark, sf, "j1"), "last_stage")


def _rank_sql(prefix, k):
    from journeyflow.schema import EVENT_IDS

    cols = [f"{prefix}{i}" for i in EVENT_IDS]
    sel = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in cols)
    return with_ctes("snap_j2") + f"""SELECT column_name, mean FROM (SELECT {sel} FROM snap_j2)
UNPIVOT (mean FOR column_name IN ({", ".join(cols)})) ORDER BY mean DESC, column_name LIMIT {k}"""


@query("e12_rank_seen_rates", sql=_rank_sql("seen_ed_", 10))
def e12a(spark, sf):
    return st.rank_column_means(_snap(spark, sf, "j2"), "seen_ed_", 10)


@query("e12_rank_count_means", sql=_rank_sql("count_ed_", 10))
def e12b(spark, sf):
    return st.rank_column_means(_snap(spark, sf, "j2"), "count_ed_", 10)


_NULL_COLS = ("max_milestone_seen", "last_stage", "first_event_name", "last_event_name")


@query("e13_null_counts", sql=with_ctes("snap_j1") + "SELECT column_name, n_null FROM (SELECT "
       + ", ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS {c}" for c in _NULL_COLS)
       + " FROM snap_j1) UNPIVOT (n_null FOR column_name IN (" + ", ".join(_NULL_COLS) + "))")
def e13(spark, sf):
    return st.null_counts(_snap(spark, sf, "j1"), _NULL_COLS)


_PS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("e15_length_percentiles", sql=with_ctes("j2") + """, n AS (SELECT id, count(*) AS n_actions FROM j2 GROUP BY id)
SELECT percentile, value FROM (SELECT """ + ", ".join(
    f"CAST(quantile_cont(n_actions, {p}) AS DOUBLE) AS p{int(round(p * 100))}" for p in _PS)
       + " FROM n) UNPIVOT (value FOR percentile IN (" + ", ".join(f"p{int(round(p * 100))}" for p in _PS) + "))")
def e15(spark, sf):
    lens = ev(spark, sf, "j2").groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"))
    return st.length_percentiles(lens, "n_actions", _PS)


@query("e15_length_percentiles_disc", sql=with_ctes("j1") + """, n AS (SELECT id, count(*) AS n_actions FROM j1 GROUP BY id),
r AS (SELECT n_actions, row_number() OVER (ORDER BY n_actions) AS rn, count(*) OVER () AS cnt FROM n)
SELECT percentile, value FROM (SELECT """ + ", ".join(
    f"CAST(min(n_actions) FILTER (WHERE rn >= ceil({p} * cnt)) AS DOUBLE) AS p{int(round(p * 100))}" for p in _PS)
       + " FROM r) UNPIVOT (value FOR percentile IN (" + ", ".join(f"p{int(round(p * 100))}" for p in _PS) + "))")
def e15d(spark, sf):
    lens = ev(spark, sf, "j1").groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"))
    return st.length_percentiles(lens, "n_actions", _PS, method="disc")


def _hist_sql(b, expr, bins, by=None, clip=None):
    byc = f"{by}, " if by else ""
    hi = f"quantile_cont(x, {clip})" if clip else "max(x)"
    return with_ctes(b) + f""", n AS (SELECT id, count(*) AS n_actions, bool_or(ed_id = 28) AS is_success FROM {b} GROUP BY id),
v AS (SELECT {byc}{expr} AS x FROM n),
e AS (SELECT min(x) AS lo, {hi} AS hi FROM v),
bb AS (SELECT {byc}CAST(CASE WHEN (hi - lo) / {bins} = 0 THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin, lo, hi
       FROM v, e WHERE x <= hi)
SELECT {byc}bin, any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins} AS bin_start,
       any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / {bins} AS bin_end, CAST(count(*) AS BIGINT) AS n
FROM bb GROUP BY {byc}bin"""


def _lens(spark, sf, b):
    return ev(spark, sf, b).groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"), F.bool_or(F.col("ed_id") == 28).alias("is_success"))


@query("e16_histogram", sql=_hist_sql("j2", "CAST(n_actions AS DOUBLE)", 10))
def e16(spark, sf):
    return st.histogram(_lens(spark, sf, "j2"), "n_actions", 10)


@query("e16_histogram_log_by_label", sql=_hist_sql("j1", "ln(1 + n_actions)", 8, by="is_success"))
def e16b(spark, sf):
    return st.histogram(_lens(spark, sf, "j1"), "n_actions", 8, log=True, by="is_success")


@query("e16_histogram_p95_clip", sql=_hist_sql("j2", "CAST(n_actions AS DOUBLE)", 12, clip=0.95))
def e16c(spark, sf):
    return st.histogram(_lens(spark, sf, "j2"), "n_actions", 12, clip_quantile=0.95)


@query("e17_success_counts", sql=with_ctes("j1") + "SELECT event_timestamp, CAST(count(*) AS BIGINT) AS count_ed_28 FROM j1 WHERE ed_id = 28 GROUP BY 1")
def e17(spark, sf):
    return st.success_counts(flat(ev(spark, sf, "j1")))


@query("e18_daily_series", sql=with_ctes("s1") + "SELECT series, date, y FROM s1")
def e18(spark, sf):
    return daily_lines(spark, sf)


@query("e18_monthly_series", sql=with_ctes("s1f") + """SELECT series, CAST(year(date) AS VARCHAR) || '-M' || CAST(month(date) AS VARCHAR) AS month,
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS m, sum(y) AS y FROM s1f GROUP BY ALL""")
def e18m(spark, sf):
    return st.monthly_series(daily_lines(spark, sf, by_flag=True))


@query("e19_score_summary", sql=with_ctes("m1") + """SELECT min(p) AS p_min, avg(p) AS p_mean, max(p) AS p_max,
       CAST(count(*) FILTER (WHERE p < 0.4) AS BIGINT) AS tier_0_count,
       CAST(count(*) FILTER (WHERE p >= 0.4 AND p < 0.6) AS BIGINT) AS tier_1_count,
       CAST(count(*) FILTER (WHERE p >= 0.6 AND p < 0.75) AS BIGINT) AS tier_2_count,
       CAST(count(*) FILTER (WHERE p >= 0.75) AS BIGINT) AS tier_3_count FROM m1""")
def e19(spark, sf):
    return st.score_summary(scores(spark, sf, ("m1",)), "p", (0.4, 0.6, 0.75))


@query("e20_class_balance", sql=with_ctes("m1") + """, g AS (SELECT CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_neg,
       CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_pos FROM m1)
SELECT n_neg, n_pos, n_pos / (n_pos + n_neg) AS pos_rate, n_neg / n_pos AS scale_pos_weight, ln(n_pos / n_neg) AS log_odds_bias FROM g""")
def e20(spark, sf):
    return st.class_balance(scores(spark, sf, ("m1",)), "y")


_CORR = ("m1", "m2", "m3", "y")


@query("e21_corr_matrix", sql=with_ctes("scores") + """, w AS (
  SELECT id, any_value(CAST(y AS DOUBLE)) AS y, max(p) FILTER (WHERE model = 'm1') AS m1,
         max(p) FILTER (WHERE model = 'm2') AS m2, max(p) FILTER (WHERE model = 'm3') AS m3 FROM scores GROUP BY id)
""" + "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM w" for a in _CORR for b in _CORR))
def e21(spark, sf):
    s = scores(spark, sf)
    w = s.groupBy("id").agg(F.first("y").cast("double").alias("y"),
                            *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(m) for m in ("m1", "m2", "m3")])
    return st.corr_matrix(w, _CORR)


@query("e22_gap_stats", sql=with_ctes("j1") + """, g AS (SELECT (us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000 AS gap FROM j1)
SELECT CAST(count(gap) AS BIGINT) AS n_gaps, CAST(sum(gap) AS DOUBLE) / count(gap) AS mean_gap_seconds, CAST(median(gap) AS DOUBLE) AS median_gap_seconds,
       max(gap) AS max_gap_seconds, min(gap) AS min_gap_seconds FROM g WHERE gap IS NOT NULL""")
def e22(spark, sf):
    return st.gap_stats(ev(spark, sf, "j1"))


@query("e22_gap_stats_by_outcome", sql=with_ctes("j2") + """, g AS (SELECT id, (us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000 AS gap,
       bool_or(ed_id = 28) OVER (PARTITION BY id) AS is_success FROM j2)
SELECT is_success, CAST(count(gap) AS BIGINT) AS n_gaps, CAST(sum(gap) AS DOUBLE) / count(gap) AS mean_gap_seconds, CAST(median(gap) AS DOUBLE) AS median_gap_seconds,
       max(gap) AS max_gap_seconds, min(gap) AS min_gap_seconds FROM g WHERE gap IS NOT NULL GROUP BY is_success""")
def e22b(spark, sf):
    return st.gap_stats(ev(spark, sf, "j2"), by_outcome=True)


@query("e23_snapshot_report", sql=with_ctes("snap_j1") + """SELECT (SELECT CAST(count(DISTINCT id) AS BIGINT) FROM j1) AS processed,
       CAST(count(*) AS BIGINT) AS written, (SELECT CAST(count(DISTINCT id) AS BIGINT) FROM j1) - CAST(count(*) AS BIGINT) AS skipped,
       CAST(sum(label_order_shipped) AS BIGINT) AS success_count, sum(label_order_shipped) / count(*) AS success_rate FROM snap_j1""")
def e23(spark, sf):
    e = ev(spark, sf, "j1")
    return st.snapshot_report(e, snap.snapshot(e, defs(spark)))


@query("f1_with_gaps", sql=with_ctes("j1") + """SELECT id, event_timestamp, ed_id,
       coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000, 0) AS gap_seconds FROM j1""")
def f1(spark, sf):
    g = st.with_gaps(ev(spark, sf, "j1"), 0)
    return g.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "gap_seconds")


@query("f2_with_elapsed", sql=with_ctes("j2") + """SELECT id, event_timestamp, ed_id, (us - min(us) OVER (PARTITION BY id)) // 1000000 AS elapsed_seconds FROM j2""")
def f2(spark, sf):
    g = st.with_elapsed(ev(spark, sf, "j2"))
    return g.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "elapsed_seconds")


@query("f3_with_step_index", sql=with_ctes("j1") + """SELECT id, event_timestamp, ed_id, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS step_index FROM j1""")
def f3(spark, sf):
    g = st.with_step_index(ev(spark, sf, "j1"))
    return g.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "step_index")


@query("f4_with_cum_seconds", sql=with_ctes("j2") + """, g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000, 0) AS gap FROM j2)
SELECT id, event_timestamp, ed_id, CAST(sum(gap) OVER (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_seconds FROM g""")
def f4(spark, sf):
    g = st.with_cum_seconds(ev(spark, sf, "j2"))
    return g.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "cum_seconds")


@query("f5_running_total", sql=with_ctes("s1f") + """SELECT series, date, y, sum(y) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_y FROM s1f""")
def f5(spark, sf):
    return st.running_total(daily_lines(spark, sf, by_flag=True))


@query("f6_centered_mean", sql=with_ctes("s1") + """SELECT series, date, y, CASE WHEN count(y) OVER w = 365 THEN avg(y) OVER w END AS trend
FROM s1 WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)""")
def f6(spark, sf):
    return st.centered_mean(daily_lines(spark, sf), 365)


@query("f7_first_last", sql=with_ctes("j1", "defs") + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS a,
       row_number() OVER (PARTITION BY id ORDER BY us DESC, ed_id DESC) AS z FROM j1),
g AS (SELECT id, max(CASE WHEN a = 1 THEN ed_id END) AS first_ed_id, max(CASE WHEN a = 1 THEN event_timestamp END) AS first_time,
       max(CASE WHEN z = 1 THEN ed_id END) AS last_ed_id, max(CASE WHEN z = 1 THEN event_timestamp END) AS last_time FROM r GROUP BY id)
SELECT g.*, f.event_name AS first_event_name, f.stage AS first_stage, l.event_name AS last_event_name, l.stage AS last_stage
FROM g LEFT JOIN defs f ON f.ed_id = g.first_ed_id LEFT JOIN defs l ON l.ed_id = g.last_ed_id""")
def f7(spark, sf):
    return st.first_last(ev(spark, sf, "j1"), defs(spark))


@query("f8_difference", sql=with_ctes("s1") + "SELECT series, date, y, y - lag(y) OVER (PARTITION BY series ORDER BY date) AS diff_y FROM s1")
def f8(spark, sf):
    return st.difference(daily_lines(spark, sf))


@query("g1_top_k", sql=with_ctes("j2") + """SELECT id, CAST(count(*) AS BIGINT) AS n_actions FROM j2 GROUP BY id ORDER BY n_actions DESC, id LIMIT 10""")
def g1(spark, sf):
    lens = ev(spark, sf, "j2").groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"))
    return st.top_k(lens, "n_actions", 10, ["id"])


@query("g2_nearest", sql=with_ctes("m1") + "SELECT id, y, p FROM m1 ORDER BY abs(p - 0.5), id LIMIT 5")
def g2(spark, sf):
    return st.nearest(scores(spark, sf, ("m1",)).select("id", "y", "p"), "p", 0.5, 5, ["id"])


@query("g3_reference_profiles", sql=with_ctes("m1") + """SELECT * FROM (
  (SELECT 'top_false_positive' AS profile, id, p FROM m1 WHERE y = 0 ORDER BY p DESC, id LIMIT 1)
  UNION ALL (SELECT 'surest_success', id, p FROM m1 WHERE y = 1 ORDER BY p DESC, id LIMIT 1)
  UNION ALL (SELECT 'surest_failure', id, p FROM m1 WHERE y = 0 ORDER BY p, id LIMIT 1))""")
def g3(spark, sf):
    return st.reference_profiles(scores(spark, sf, ("m1",)))


@query("h1_union_all", sql=with_ctes("j1", "j2") + """SELECT 'j1' AS source, id, event_timestamp, ed_id FROM j1
UNION ALL SELECT 'j2', id, event_timestamp, ed_id FROM j2""")
def h1(spark, sf):
    a = flat(ev(spark, sf, "j1")).select(F.lit("j1").alias("source"), "*")
    b = flat(ev(spark, sf, "j2")).select(F.lit("j2").alias("source"), "*")
    return st.union_all([a, b])


@query("d4_semi_join_ids", sql=with_ctes("j2") + """SELECT id, event_timestamp, ed_id FROM j2
WHERE id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def d4(spark, sf):
    """Keep the events of customers with an urgent fulfilled order (left semi join)."""
    from journeyflow.operators.project import keep_ids
    from journeyflow.plans.common import table

    ids = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("id"))
    return keep_ids(flat(ev(spark, sf, "j2")), ids)


@query("d6_row_grid_cross_product", sql=with_ctes("m1") + """, g(t) AS (VALUES (0.1), (0.3), (0.5), (0.7), (0.9))
SELECT m1.id, CAST(g.t AS DOUBLE) AS threshold, CAST(m1.p >= g.t AS INTEGER) AS y_hat FROM m1 CROSS JOIN g""")
def d6(spark, sf):
    """Every row x a parameter grid, exploded in the map (no shuffle)."""
    grid = F.array(*[F.lit(t) for t in (0.1, 0.3, 0.5, 0.7, 0.9)])
    x = scores(spark, sf, ("m1",)).select("id", "p", F.explode(grid).alias("threshold"))
    return x.select("id", "threshold", (F.col("p") >= F.col("threshold")).cast("int").alias("y_hat"))


@query("d7_cutoff_filter", sql=with_ctes("j1_c", "j1") + """SELECT e.id, e.event_timestamp, e.ed_id FROM j1 e JOIN j1_c c ON e.id = c.id WHERE e.us <= c.cutoff_us""")
def d7(spark, sf):
    """Event x per-journey cutoff (equi-join on id + residual ts <= cutoff)."""
    return flat(snap.observed_prefix(ev(spark, sf, "j1")))


@query("g4_sort_within_journey", sql=with_ctes("j2") + """SELECT id, event_timestamp, ed_id, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS step_index FROM j2""")
def g4(spark, sf):
    g = st.with_step_index(ev(spark, sf, "j2"))
    return g.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "step_index")


@query("e16_histogram_duration_p95", sql=with_ctes("j2") + """, n AS (SELECT id, (max(us) - min(us)) / 86400e6 AS d FROM j2 GROUP BY id),
v AS (SELECT d AS x FROM n),
e AS (SELECT min(x) AS lo, quantile_cont(x, 0.95) AS hi FROM v),
bb AS (SELECT CAST(CASE WHEN (hi - lo) / 20 = 0 THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, lo, hi
       FROM v, e WHERE x <= hi)
SELECT bin, any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20 AS bin_start,
       any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 20 AS bin_end, CAST(count(*) AS BIGINT) AS n
FROM bb GROUP BY bin""")
def e16d(spark, sf):
    """E16 on a continuous value: journey duration in days, clipped at its exact 95th percentile."""
    d = st.journey_stats(ev(spark, sf, "j2")).select("id", "duration_days")
    return st.histogram(d, "duration_days", 20, clip_quantile=0.95)
