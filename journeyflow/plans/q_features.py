"""Catalogue: feature engineering (L1-L15) and the per-step score timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import features as fe
from journeyflow.operators import snapshot as snap
from journeyflow.operators import timeline as tl
from journeyflow.plans.common import defs, ev
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.schema import (APPLICATION_IDS, APPROVAL_IDS, DOWNPAYMENT_IDS, FIRST_PURCHASE_IDS, ORDER_INTENT_IDS,
                                PROSPECTING_IDS)
from journeyflow.sources.bindings import FIXED_MODELS


def _ids(ids):
    return ", ".join(str(i) for i in ids)


@query("l1_ratio_features", sql=with_ctes("snap_j2") + """SELECT id,
       n_events_observed / (observed_duration_days + 1e-5) AS velocity_events_per_day,
       n_unique_event_types_observed / (observed_duration_days + 1e-5) AS velocity_unique_events_per_day,
       n_unique_event_types_observed / (n_events_observed + 1e-5) AS ratio_unique_to_total_events,
       days_since_last_event / (observed_duration_days + 1e-5) AS ratio_inactive_to_active_days FROM snap_j2""")
def l1(spark, sf):
    r = fe.ratio_features(snap.snapshot(ev(spark, sf, "j2"), defs(spark)))
    return r.select("id", "velocity_events_per_day", "velocity_unique_events_per_day", "ratio_unique_to_total_events",
                    "ratio_inactive_to_active_days")


_OPEN = """, fs AS (SELECT id, us, ed_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS rn FROM {b} WHERE ed_id = 28) WHERE rn = 1),
pe AS (SELECT e.id, e.us, e.ed_id FROM {b} e LEFT JOIN fs ON e.id = fs.id
       WHERE fs.id IS NULL OR e.us < fs.us OR (e.us = fs.us AND e.ed_id < fs.ed_id))"""

_STATIC = """, pf AS (SELECT id, min(us) AS s, max(us) AS l FROM {src} GROUP BY id),
se AS (SELECT x.id, x.us, x.ed_id, (x.us - pf.s) // 1000000 AS abs_s,
              coalesce((x.us - lag(x.us) OVER (PARTITION BY x.id ORDER BY x.us, x.ed_id)) // 1000000, 0) AS gap_s,
              (pf.l - pf.s) // 1000000 AS total_s,
              row_number() OVER (PARTITION BY x.id ORDER BY x.us, x.ed_id) AS rf,
              row_number() OVER (PARTITION BY x.id ORDER BY x.us DESC, x.ed_id DESC) AS rl
       FROM {src} x JOIN pf ON x.id = pf.id),
sg AS (SELECT id, CAST(count(*) AS DOUBLE) AS L, CAST(any_value(total_s) AS DOUBLE) AS T,
       CAST(max(CASE WHEN rl = 1 THEN gap_s END) AS DOUBLE) AS last_gap, CAST(sum(gap_s) AS DOUBLE) / count(gap_s) AS mean_gap,
       CAST(median(gap_s) AS DOUBLE) AS median_gap, CAST(max(gap_s) AS DOUBLE) AS max_gap,
       avg(CASE WHEN gap_s = 0 THEN 1.0 ELSE 0.0 END) AS zero_gap_share, CAST(count(DISTINCT ed_id) AS DOUBLE) AS uq,
       CAST(max(CASE WHEN rf = 1 THEN ed_id END) AS DOUBLE) AS fe, CAST(max(CASE WHEN rl = 1 THEN ed_id END) AS DOUBLE) AS le,
       CAST(max(CASE WHEN ed_id IN (12, 15) THEN 1 WHEN ed_id IN (7, 18) THEN 2 WHEN ed_id = 29 THEN 3
                     WHEN ed_id IN (8, 25) THEN 4 WHEN ed_id IN (26, 27) THEN 5 ELSE 0 END) AS DOUBLE) AS ms,
       count(*) FILTER (WHERE ed_id IN ({app})) AS app, count(*) FILTER (WHERE ed_id IN ({apr})) AS apr,
       count(*) FILTER (WHERE ed_id IN ({fp})) AS fp, count(*) FILTER (WHERE ed_id IN ({oi})) AS oi,
       count(*) FILTER (WHERE ed_id IN ({dp})) AS dp, count(*) FILTER (WHERE ed_id IN ({pr})) AS pr,
       count(*) FILTER (WHERE total_s <= 0 OR abs_s >= total_s - 18000) AS e5h,
       count(*) FILTER (WHERE total_s <= 0 OR abs_s >= total_s - 86400) AS e1d,
       count(*) FILTER (WHERE total_s <= 0 OR abs_s >= total_s - 259200) AS e3d,
       count(*) FILTER (WHERE (total_s <= 0 OR abs_s >= total_s - 18000) AND ed_id IN ({oi})) AS i5h,
       count(*) FILTER (WHERE (total_s <= 0 OR abs_s >= total_s - 86400) AND ed_id IN ({oi})) AS i1d,
       count(*) FILTER (WHERE (total_s <= 0 OR abs_s >= total_s - 259200) AND ed_id IN ({oi})) AS i3d,
       max(abs_s) FILTER (WHERE ed_id IN ({app})) AS la, max(abs_s) FILTER (WHERE ed_id IN ({oi})) AS lo,
       max(abs_s) FILTER (WHERE ed_id IN ({dp})) AS ld
FROM se GROUP BY id),
sv AS (SELECT id,
  ln(1 + L) AS log1p_journey_length, ln(1 + T) AS log1p_total_elapsed_seconds, ln(1 + last_gap) AS log1p_last_gap_seconds,
  ln(1 + mean_gap) AS log1p_mean_gap_seconds, ln(1 + median_gap) AS log1p_median_gap_seconds, ln(1 + max_gap) AS log1p_max_gap_seconds,
  zero_gap_share, ln(1 + uq) AS log1p_unique_event_count, uq / greatest(L, 1.0) AS event_diversity_ratio,
  fe AS first_event_id, le AS last_event_id, ms AS max_milestone_seen,
  CAST(app > 0 AS DOUBLE) AS seen_application, CAST(apr > 0 AS DOUBLE) AS seen_approval, CAST(fp > 0 AS DOUBLE) AS seen_first_purchase,
  CAST(oi > 0 AS DOUBLE) AS seen_order_intent, CAST(dp > 0 AS DOUBLE) AS seen_downpayment, CAST(pr > 0 AS DOUBLE) AS seen_prospecting,
  ln(1 + app) AS log1p_application_count, ln(1 + fp) AS log1p_first_purchase_count, ln(1 + oi) AS log1p_order_intent_count,
  ln(1 + dp) AS log1p_downpayment_count, ln(1 + pr) AS log1p_prospecting_count, oi / greatest(L, 1.0) AS order_intent_share,
  L / greatest(T / 86400.0, 1.0 / 86400.0) AS event_velocity_per_day,
  app / greatest(T / 86400.0, 1.0 / 86400.0) AS application_velocity_per_day,
  oi / greatest(T / 86400.0, 1.0 / 86400.0) AS order_intent_velocity_per_day,
  CAST(e5h AS DOUBLE) AS events_last_5h, CAST(e1d AS DOUBLE) AS events_last_1d, CAST(e3d AS DOUBLE) AS events_last_3d,
  CAST(i5h AS DOUBLE) AS intent_last_5h, CAST(i1d AS DOUBLE) AS intent_last_1d, CAST(i3d AS DOUBLE) AS intent_last_3d,
  ln(1 + CASE WHEN la IS NULL THEN T + 86400 ELSE greatest(T - la, 0.0) END) AS log1p_seconds_since_last_application,
  ln(1 + CASE WHEN lo IS NULL THEN T + 86400 ELSE greatest(T - lo, 0.0) END) AS log1p_seconds_since_last_order_intent,
  ln(1 + CASE WHEN ld IS NULL THEN T + 86400 ELSE greatest(T - ld, 0.0) END) AS log1p_seconds_since_last_downpayment,
  ln(1 + T) AS log1p_cutoff_elapsed_seconds, 0.0 AS log1p_seconds_since_last_event_at_cutoff
FROM sg)""".replace("{app}", _ids(APPLICATION_IDS)).replace("{apr}", _ids(APPROVAL_IDS)).replace("{fp}", _ids(FIRST_PURCHASE_IDS)) \
    .replace("{oi}", _ids(ORDER_INTENT_IDS)).replace("{dp}", _ids(DOWNPAYMENT_IDS)).replace("{pr}", _ids(PROSPECTING_IDS))


@query("l3_static_features", sql=with_ctes("j2") + _OPEN.format(b="j2") + _STATIC.replace("{src}", "pe") + """
SELECT i.id, """ + ", ".join(f"coalesce(sv.{n}, 0.0) AS {n}" for n in fe.STATIC_FEATURE_NAMES) + """
FROM (SELECT DISTINCT id FROM j2) i LEFT JOIN sv ON i.id = sv.id""")
def l3(spark, sf):
    e = ev(spark, sf, "j2")
    return fe.static_features(snap.open_prefix(e), ids=e.select("id").distinct())


@query("l3_static_features_j1", sql=with_ctes("j1") + _STATIC.replace("{src}", "j1") + " SELECT * FROM sv")
def l3b(spark, sf):
    return fe.static_features(ev(spark, sf, "j1"))


@query("l11_step_features", sql=with_ctes("j1") + """SELECT id, event_timestamp, ed_id,
       sin(2 * pi() * hour(event_timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(event_timestamp) / 24) AS hour_cos,
       sin(2 * pi() * isodow(event_timestamp) / 7) AS dow_sin, cos(2 * pi() * isodow(event_timestamp) / 7) AS dow_cos,
       CAST(isodow(event_timestamp) AS INTEGER) AS day_of_week, CAST(month(event_timestamp) AS INTEGER) AS month,
       coalesce((us - lag(us) OVER w) // 1000000, 0) AS delta_seconds, row_number() OVER w AS step_index
FROM j1 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id)""")
def l11(spark, sf):
    return fe.step_features(ev(spark, sf, "j1"))


@query("l12_step_states", sql=with_ctes("j2") + """SELECT id, row_number() OVER w AS step_index, ed_id,
       (us - min(us) OVER (PARTITION BY id)) / 3.6e9 AS hours_since_start,
       CAST(sum(CASE WHEN ed_id = 11 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cart_adds_so_far,
       CAST(sum(CASE WHEN ed_id = 6 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS checkouts_so_far
FROM j2 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def l12(spark, sf):
    return fe.step_states(ev(spark, sf, "j2"))


@query("l13_observed_sequences", sql=with_ctes("j1") + """, g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000, 0) AS gap FROM j1)
SELECT id, string_agg(CAST(ed_id AS VARCHAR), ',' ORDER BY us, ed_id) AS observed_sequence,
       string_agg(CAST(gap AS VARCHAR), ',' ORDER BY us, ed_id) AS observed_time_deltas FROM g GROUP BY id""")
def l13(spark, sf):
    o = fe.observed_sequences(ev(spark, sf, "j1"))
    return o.select("id", F.array_join(F.transform("observed_sequence", lambda x: x.cast("string")), ",").alias("observed_sequence"),
                    F.array_join(F.transform("observed_time_deltas", lambda x: x.cast("string")), ",").alias("observed_time_deltas"))


@query("l15_markov_features", sql=with_ctes("j2") + _STATIC.replace("{src}", "j2") + """
SELECT id, mean_gap AS mean_gap_seconds, T AS elapsed_seconds, CAST(L AS BIGINT) AS n_events, CAST(uq AS BIGINT) AS n_unique_events, ms AS max_milestone, CAST(dp AS BIGINT) AS downpayment_count,
       CAST(pr AS BIGINT) AS prospecting_count, CAST(le AS INTEGER) AS last_ed_id, CAST(e3d AS BIGINT) AS events_last_3d FROM sg""")
def l15(spark, sf):
    return fe.markov_features(ev(spark, sf, "j2"))


def _fixed_scorer(model: str = "m1"):
    """A fixed-coefficient model of the timeline's state (binding P)."""
    def score(states):
        intent = F.col("count_ed_11") + F.col("count_ed_6") + F.col("count_ed_5")
        x = [F.log1p(F.col("n_events_observed").cast("double")), F.log1p("days_since_last_event"), F.coalesce("max_milestone_seen", F.lit(0.0)),
             F.log1p(intent.cast("double")), F.col("observed_duration_days") / 365.0]
        b0, w = FIXED_MODELS[model]
        z = F.lit(b0)
        for wi, xi in zip(w, x, strict=True):
            z = z + F.lit(wi) * xi
        return states.withColumn("p", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6))

    return score


@query("k12_score_timeline", sql=with_ctes("j1") + """, r AS (
  SELECT id, event_timestamp, ed_id, us, row_number() OVER w AS step,
         CAST(CASE WHEN sum(CASE WHEN ed_id = 28 THEN 1 ELSE 0 END) OVER w > 0 THEN 6
              WHEN sum(CASE WHEN ed_id = 27 THEN 1 ELSE 0 END) OVER w > 0 THEN 5
              WHEN sum(CASE WHEN ed_id IN (8, 25) THEN 1 ELSE 0 END) OVER w > 0 THEN 4
              WHEN sum(CASE WHEN ed_id = 29 THEN 1 ELSE 0 END) OVER w > 0 THEN 3
              WHEN sum(CASE WHEN ed_id IN (7, 18) THEN 1 ELSE 0 END) OVER w > 0 THEN 2
              WHEN sum(CASE WHEN ed_id IN (12, 15) THEN 1 ELSE 0 END) OVER w > 0 THEN 1 ELSE 0 END AS DOUBLE) AS milestone_so_far,
         sum(CASE WHEN ed_id IN (11, 6, 5) THEN 1 ELSE 0 END) OVER w AS intent,
         us - min(us) OVER (PARTITION BY id) AS el
  FROM j1 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, step, event_timestamp, ed_id, milestone_so_far,
       round(1 / (1 + exp(-(-2.0 + 0.8 * ln(1 + step) - 0.5 * 0.0 + 0.4 * milestone_so_far + 0.6 * ln(1 + intent) - 0.3 * (el / 86400e6 / 365.0)))), 6) AS p
FROM r""")
def k12(spark, sf):
    t = tl.score_timeline(ev(spark, sf, "j1"), _fixed_scorer(), event_ids=(5, 6, 11), unique=False)
    return t.select("id", "step", F.col("cutoff_time").alias("event_timestamp"), F.col("last_ed_id").alias("ed_id"),
                    F.coalesce("max_milestone_seen", F.lit(0.0)).alias("milestone_so_far"), "p")


@query("k12_timeline_states", sql=with_ctes("j1") + """, c AS (SELECT id FROM j1 GROUP BY id HAVING count(*) >= 4),
t AS (SELECT j1.*, CAST(row_number() OVER (PARTITION BY id, ed_id ORDER BY us) = 1 AS INTEGER) AS fresh FROM j1 WHERE id IN (SELECT id FROM c))
SELECT id, row_number() OVER w AS step, event_timestamp AS cutoff_time, CAST(sum(fresh) OVER w AS BIGINT) AS n_unique_event_types_observed,
       (us - min(us) OVER (PARTITION BY id)) / 86400e6 AS observed_duration_days, CAST(hour(event_timestamp) AS INTEGER) AS cutoff_hour_utc,
       first_value(ed_id) OVER w AS first_ed_id, ed_id AS last_ed_id,
       max(CASE WHEN ed_id = 28 THEN 6.0 WHEN ed_id = 27 THEN 5.0 WHEN ed_id IN (8, 25) THEN 4.0 WHEN ed_id = 29 THEN 3.0 WHEN ed_id IN (7, 18) THEN 2.0
                WHEN ed_id IN (12, 15) THEN 1.0 END) OVER w AS max_milestone_seen,
       CAST(sum(CASE WHEN ed_id = 4 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS count_ed_4, sum(CASE WHEN ed_id = 28 THEN 1 ELSE 0 END) OVER w > 0 AS seen_ed_28
FROM t WINDOW w AS (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def k12s(spark, sf):
    """The states of chosen journeys: those with four events or more."""
    e = ev(spark, sf, "j1")
    chosen = e.groupBy("id").agg(F.count("*").alias("n")).where("n >= 4")
    return tl.timeline_states(e, chosen).select("id", "step", "cutoff_time", "n_unique_event_types_observed", "observed_duration_days", "cutoff_hour_utc", "first_ed_id",
                                                "last_ed_id", "max_milestone_seen", "count_ed_4", "seen_ed_28")


# The parts of the static vector (same single aggregate, column subsets)
_PARTS = {
    "l4_gap_features": ("log1p_last_gap_seconds", "log1p_mean_gap_seconds", "log1p_median_gap_seconds", "log1p_max_gap_seconds", "zero_gap_share"),
    "l5_diversity_features": ("log1p_unique_event_count", "event_diversity_ratio", "first_event_id", "last_event_id"),
    "l6_max_milestone": ("max_milestone_seen",),
    "l7_group_features": ("seen_application", "seen_approval", "seen_first_purchase", "seen_order_intent", "seen_downpayment",
                          "seen_prospecting", "log1p_application_count", "log1p_first_purchase_count", "log1p_order_intent_count",
                          "log1p_downpayment_count", "log1p_prospecting_count", "order_intent_share"),
    "l8_velocities": ("event_velocity_per_day", "application_velocity_per_day", "order_intent_velocity_per_day"),
    "l9_trailing_windows": ("events_last_5h", "events_last_1d", "events_last_3d", "intent_last_5h", "intent_last_1d", "intent_last_3d"),
    "l10_seconds_since_last": ("log1p_seconds_since_last_application", "log1p_seconds_since_last_order_intent",
                               "log1p_seconds_since_last_downpayment"),
}


def _part(cols_):
    def run(spark, sf):
        return fe.static_features(ev(spark, sf, "j1")).select("id", *cols_)
    return run


for _k, _c in _PARTS.items():
    query(_k, sql=with_ctes("j1") + _STATIC.replace("{src}", "j1") + " SELECT id, " + ", ".join(_c) + " FROM sv")(_part(_c))


@query("l14_empty_journey_zero_vector", sql=with_ctes("j1") + _OPEN.format(b="j1") + _STATIC.replace("{src}", "pe") + """
SELECT i.id, """ + ", ".join(f"coalesce(sv.{n}, 0.0) AS {n}" for n in fe.STATIC_FEATURE_NAMES) + """
FROM (SELECT DISTINCT id FROM j1) i LEFT JOIN sv ON i.id = sv.id""")
def l14(spark, sf):
    e = ev(spark, sf, "j1")
    return fe.static_features(snap.open_prefix(e), ids=e.select("id").distinct())


@query("a9_write_feature_set", sql=with_ctes("j2") + _OPEN.format(b="j2") + _STATIC.replace("{src}", "pe") + """,
full_ AS (SELECT i.id, """ + ", ".join(f"coalesce(sv.{n}, 0.0) AS {n}" for n in fe.STATIC_FEATURE_NAMES) + """
  FROM (SELECT DISTINCT id FROM j2) i LEFT JOIN sv ON i.id = sv.id)
SELECT """ + ", ".join(f"avg({n}) AS {n}_mean, CASE WHEN stddev_pop({n}) < 1e-6 THEN 1.0 ELSE stddev_pop({n}) END AS {n}_std"
                        for n in fe.STATIC_FEATURE_NAMES) + " FROM full_")
def a9(spark, sf):
    """Static features + their normalisation statistics persisted as two parquet tables;
    the statistics table is read back."""
    import uuid

    from journeyflow.operators.prep import fit_scaler
    from journeyflow.session import ensure_checkpoint_dir
    from journeyflow.sources import files

    e = ev(spark, sf, "j2")
    feats = fe.static_features(snap.open_prefix(e), ids=e.select("id").distinct())
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-features-{uuid.uuid4().hex}"
    files.write_feature_set(feats, fit_scaler(feats, fe.STATIC_FEATURE_NAMES, floor=1e-6), path)
    return spark.read.parquet(f"{path}/stats")
