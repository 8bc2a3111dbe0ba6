"""Catalogue: labelling, truncation and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import snapshot as snap
from journeyflow.plans.common import defs, ev, flat, sql_u
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.schema import EVENT_IDS, from_us

_DAY = 86400000000


def _frame_sql(b: str, seed: int = 42) -> str:
    """Journey frame -> terminal -> weight -> cutoff, as CTEs ``fr``, ``c`` over binding ``b``."""
    return f"""fr AS (
  SELECT id, min(us) AS start_us, max(us) AS last_us, count(*) AS n_actions,
         min(CASE WHEN ed_id = 28 THEN us END) AS success_us
  FROM {b} GROUP BY id),
t AS (
  SELECT *, CASE WHEN success_us IS NOT NULL THEN 1 ELSE 0 END AS label_order_shipped,
         CASE WHEN success_us IS NOT NULL THEN success_us ELSE last_us + 60 * {_DAY} END AS terminal_us,
         CASE WHEN success_us IS NOT NULL THEN 'success' ELSE 'inactive_60d' END AS journey_terminal_reason
  FROM fr),
c AS (
  SELECT *, CAST(greatest(1, ceil(greatest((terminal_us - start_us) / {float(_DAY)}, 0.0))) AS INTEGER) AS sampling_weight_days,
         CASE WHEN terminal_us - 1 <= start_us THEN start_us
              ELSE start_us + CAST(floor({sql_u('id', seed)} * CAST(terminal_us - 1 - start_us AS DOUBLE)) AS BIGINT) END AS cutoff_us
  FROM t)"""


for _b in ("j1", "j2"):

    def _k1(spark, sf, b=_b):
        return snap.journey_status(ev(spark, sf, b))

    query(
        f"k1_journey_status_{_b}",
        sql=with_ctes(_b)
        + f"""SELECT id,
       CASE WHEN bool_or(ed_id = 28) THEN 'success'
            WHEN (SELECT max(us) FROM {_b}) - max(us) >= 60 * {_DAY} THEN 'unsuccessful'
            ELSE 'ongoing' END AS status,
       make_timestamp(max(us)) AS last_event_time,
       make_timestamp((SELECT max(us) FROM {_b})) AS endpoint_time
FROM {_b} GROUP BY id""",
    )(_k1)

    def _k7(spark, sf, b=_b):
        return snap.snapshot(ev(spark, sf, b), defs(spark))

    query(f"k7_snapshot_{_b}", sql=with_ctes(f"snap_{_b}") + f"SELECT * FROM snap_{_b}")(_k7)


@query(
    "k2_label_journeys",
    sql=with_ctes("j1")
    + """SELECT id, CASE WHEN bool_or(ed_id = 28) THEN 1 ELSE 0 END AS label_order_shipped,
       make_timestamp(min(CASE WHEN ed_id = 28 THEN us END)) AS first_success_time, CAST(count(*) AS BIGINT) AS n_actions
FROM j1 GROUP BY id""",
)
def k2(spark, sf):
    return snap.label_journeys(ev(spark, sf, "j1"))


@query(
    "k3_terminal",
    sql=with_ctes("j2", extra=_frame_sql("j2"))
    + "SELECT id, label_order_shipped, make_timestamp(terminal_us) AS journey_terminal_time, journey_terminal_reason FROM c",
)
def k3(spark, sf):
    return snap.terminal(ev(spark, sf, "j2"))


@query("k4_sampling_weight", sql=with_ctes("j2", extra=_frame_sql("j2")) + "SELECT id, sampling_weight_days FROM c")
def k4(spark, sf):
    return snap.sampling_weight(ev(spark, sf, "j2"))


@query(
    "k5_choose_cutoff",
    sql=with_ctes("j1", extra=_frame_sql("j1"))
    + """SELECT id, make_timestamp(start_us) AS start_time, make_timestamp(cutoff_us) AS cutoff_time,
       make_timestamp(terminal_us) AS journey_terminal_time FROM c""",
)
def k5(spark, sf):
    return snap.choose_cutoff(ev(spark, sf, "j1"))


@query(
    "k6_observed_prefix",
    sql=with_ctes("j2", extra=_frame_sql("j2"))
    + "SELECT e.id, e.event_timestamp, e.ed_id FROM j2 e JOIN c ON e.id = c.id WHERE e.us <= c.cutoff_us",
)
def k6(spark, sf):
    return flat(snap.observed_prefix(ev(spark, sf, "j2")))


_PIV = ",\n       ".join(
    f"CAST(count(*) FILTER (WHERE ed_id = {k}) AS BIGINT) AS count_ed_{k}, (count(*) FILTER (WHERE ed_id = {k}) > 0) AS seen_ed_{k}"
    for k in EVENT_IDS
)


@query("k8_event_pivot", sql=with_ctes("j2") + f"SELECT id, {_PIV} FROM j2 GROUP BY id")
def k8(spark, sf):
    p = snap.event_pivot(ev(spark, sf, "j2"))
    return p.select("id", *[F.col(c).cast("long").alias(c) if c.startswith("count_") else F.col(c) for c in p.columns[1:]])


_K9_SQL = """, u AS (
  SELECT e.*, fr.success_us FROM {b} e JOIN fr ON e.id = fr.id
  WHERE e.ed_id <> 28 AND (fr.success_us IS NULL OR e.us < fr.success_us)),
s AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS step, count(*) OVER (PARTITION BY id) AS n_usable FROM u),
p AS (
  SELECT * FROM s WHERE n_usable >= 2
    AND step <= greatest(2, 1 + CAST(floor({u} * n_usable) AS BIGINT)))
SELECT p.id, CASE WHEN any_value(p.success_us) IS NOT NULL THEN 1 ELSE 0 END AS label_order_shipped,
       greatest((max(p.us) - min(p.us)) / 1e6, 0.0) AS cutoff_elapsed_seconds,
       0.0 AS seconds_since_last_event_at_cutoff,
       greatest((max(p.us) - min(p.us)) / 1e6, 0.0) AS observed_duration_seconds,
       CAST(count(*) AS BIGINT) AS n_events_observed
FROM p GROUP BY p.id"""


for _b in ("j1", "j2"):

    def _k9(spark, sf, b=_b):
        return snap.prefix_snapshot_summary(ev(spark, sf, b))

    query(
        f"k9_prefix_snapshot_{_b}",
        sql=with_ctes(_b, extra=_frame_sql(_b)) + _K9_SQL.format(b=_b, u=sql_u("id", 42)),
    )(_k9)


@query(
    "k10_open_prefix",
    sql=with_ctes("j1")
    + """, f AS (SELECT id, us, ed_id, row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS rn FROM j1 WHERE ed_id = 28)
SELECT e.id, e.event_timestamp, e.ed_id FROM j1 e LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON e.id = f.id
WHERE f.id IS NULL OR e.us < f.us OR (e.us = f.us AND e.ed_id < f.ed_id)""",
)
def k10(spark, sf):
    return flat(snap.open_prefix(ev(spark, sf, "j1")))


@query(
    "k11_oversample_by_days",
    sql=with_ctes("j1", extra=_frame_sql("j1"))
    + f""", x AS (SELECT c.*, unnest(range(1, sampling_weight_days + 1)) AS copy FROM c)
SELECT id, CAST(copy AS INTEGER) AS copy,
       make_timestamp(CASE WHEN terminal_us - 1 <= start_us THEN start_us
            ELSE start_us + CAST(floor({sql_u('id', '42 + copy')} * CAST(terminal_us - 1 - start_us AS DOUBLE)) AS BIGINT) END) AS cutoff_time
FROM x""",
)
def k11(spark, sf):
    return snap.oversample_by_days(ev(spark, sf, "j1"))


@query(
    "k13_sessionize",
    sql=with_ctes("j2")
    + """, g AS (SELECT *, lag(us) OVER (PARTITION BY id ORDER BY us, ed_id) AS prev_us FROM j2),
s AS (SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > 30 * 86400000000 THEN 1 ELSE 0 END)
       OVER (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT id, CAST(session AS BIGINT) AS session, make_timestamp(min(us)) AS session_start, make_timestamp(max(us)) AS session_end,
       CAST(count(*) AS BIGINT) AS n_events
FROM s GROUP BY id, session""",
)
def k13(spark, sf):
    return snap.session_summary(ev(spark, sf, "j2"), 30 * 86400)
