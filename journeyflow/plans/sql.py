"""Shared CTE text for the DuckDB oracles: the test-table bindings written in SQL.

The bindings are defined in FIXTURES.md; these CTEs are written from that definition,
independently of the Spark code in ``journeyflow.sources.bindings``.
"""

from __future__ import annotations

from journeyflow.schema import EVENT_DEFINITIONS


def _defs_values() -> str:
    rows = []
    for name, jid, ed, ms, stage in EVENT_DEFINITIONS:
        m = "CAST(NULL AS DOUBLE)" if ms is None else f"CAST({ms} AS DOUBLE)"
        rows.append(f"('{name}', {jid}, {ed}, {m}, '{stage}')")
    return ",\n    ".join(rows)


_CTE = {
    "defs": (
        (),
        "defs(event_name, journey_id, ed_id, milestone_number, stage) AS (VALUES\n    " + _defs_values() + ")",
    ),
    "j1_e": (
        (),
        """j1_e AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
         lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS prev_us
  FROM events)""",
    ),
    "j1_s": (
        ("j1_e",),
        """j1_s AS (
  SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > 43200000000 THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM j1_e)""",
    ),
    "j1": (
        ("j1_s",),
        """j1 AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(sid AS BIGINT) AS VARCHAR) AS id,
         make_timestamp(us) AS event_timestamp,
         CAST(CASE event_type
           WHEN 'purchase' THEN 28
           WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 19 ELSE 23 END
           WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 4 ELSE 5 END
           WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 11 ELSE 6 END
           ELSE CASE event_id % 4 WHEN 0 THEN 13 WHEN 1 THEN 37 WHEN 2 THEN 8 ELSE 24 END END AS INTEGER) AS ed_id,
         us, event_id
  FROM j1_s)""",
    ),
    "j2": (
        (),
        """j2 AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id,
         make_timestamp(epoch_us(o_orderdate) + (o_orderkey * 7919 % 86400) * 1000000) AS event_timestamp,
         CAST(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN 28
           ELSE CASE o_orderkey % 9 WHEN 0 THEN 12 WHEN 1 THEN 19 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 11
                                    WHEN 5 THEN 6 WHEN 6 THEN 2 WHEN 7 THEN 8 ELSE 24 END END AS INTEGER) AS ed_id,
         epoch_us(o_orderdate) + (o_orderkey * 7919 % 86400) * 1000000 AS us,
         o_orderkey AS event_id
  FROM orders)""",
    ),
    "dup": (
        ("j1",),
        """dup AS (SELECT * FROM j1 UNION ALL SELECT * FROM j1 WHERE event_id % 17 = 0)""",
    ),
    "s1": (
        (),
        """s1 AS (
  SELECT 'all' AS series, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS date, CAST(count(*) AS DOUBLE) AS y
  FROM lineitem GROUP BY 2)""",
    ),
    "s1f": (
        (),
        """s1f AS (
  SELECT l_returnflag AS series, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS date, CAST(count(*) AS DOUBLE) AS y
  FROM lineitem GROUP BY 1, 2)""",
    ),
}


_DAY = 86400000000


def _scores_cte() -> dict:
    u = "(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) / 4294967296.0)"
    return {
        "p_fr": (("j2",), f"""p_fr AS (
  SELECT id, min(us) AS start_us, max(us) AS last_us, min(CASE WHEN ed_id = 28 THEN us END) AS success_us
  FROM j2 GROUP BY id)"""),
        "p_c": (("p_fr",), f"""p_c AS (
  SELECT *, CASE WHEN success_us IS NOT NULL THEN 1 ELSE 0 END AS y,
         CASE WHEN coalesce(success_us, last_us + 60 * {_DAY}) - 1 <= start_us THEN start_us
              ELSE start_us + CAST(floor({u} * CAST(coalesce(success_us, last_us + 60 * {_DAY}) - 1 - start_us AS DOUBLE)) AS BIGINT) END AS cutoff_us
  FROM p_fr)"""),
        "p_x": (("p_c", "defs"), f"""p_x AS (
  SELECT c.id, any_value(c.y) AS y,
         ln(1 + count(*)) AS x1,
         ln(1 + greatest((any_value(c.cutoff_us) - max(e.us)) / {float(_DAY)}, 0.0)) AS x2,
         coalesce(max(d.milestone_number), 0.0) AS x3,
         ln(1 + count(*) FILTER (WHERE e.ed_id IN (11, 6, 5))) AS x4,
         greatest((any_value(c.cutoff_us) - min(e.us)) / {float(_DAY)}, 0.0) / 365.0 AS x5
  FROM j2 e JOIN p_c c ON e.id = c.id LEFT JOIN defs d ON d.ed_id = e.ed_id
  WHERE e.us <= c.cutoff_us GROUP BY c.id)"""),
        "scores": (("p_x",), """scores AS (
  SELECT 'm1' AS model, id, y, round(1 / (1 + exp(-(-2.0 + 0.8 * x1 - 0.5 * x2 + 0.4 * x3 + 0.6 * x4 - 0.3 * x5))), 6) AS p, x1, x2, x3, x4, x5 FROM p_x
  UNION ALL
  SELECT 'm2', id, y, round(1 / (1 + exp(-(-1.5 + 0.5 * x1 - 0.8 * x2 + 0.6 * x3 + 0.3 * x4 + 0.0 * x5))), 6), x1, x2, x3, x4, x5 FROM p_x
  UNION ALL
  SELECT 'm3', id, y, round(1 / (1 + exp(-(-2.5 + 1.0 * x1 - 0.3 * x2 + 0.2 * x3 + 0.9 * x4 - 0.6 * x5))), 6), x1, x2, x3, x4, x5 FROM p_x)"""),
        "m1": (("scores",), "m1 AS (SELECT id, y, p FROM scores WHERE model = 'm1')"),
    }


_CTE.update(_scores_cte())


def _snapshot_ctes(b: str) -> dict:
    """K7 snapshot over binding ``b`` as CTE ``snap_<b>`` (written from the K7 definition)."""
    from journeyflow.schema import EVENT_IDS

    u = "(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) / 4294967296.0)"
    pivot = ",\n       ".join(
        f"CAST(count(*) FILTER (WHERE o.ed_id = {k}) AS BIGINT) AS count_ed_{k}, (count(*) FILTER (WHERE o.ed_id = {k}) > 0) AS seen_ed_{k}"
        for k in EVENT_IDS
    )
    return {
        f"{b}_c": ((b,), f"""{b}_c AS (
  SELECT *, CAST(greatest(1, ceil(greatest((terminal_us - start_us) / {float(_DAY)}, 0.0))) AS INTEGER) AS sampling_weight_days,
         CASE WHEN terminal_us - 1 <= start_us THEN start_us
              ELSE start_us + CAST(floor({u} * CAST(terminal_us - 1 - start_us AS DOUBLE)) AS BIGINT) END AS cutoff_us
  FROM (
    SELECT *, CASE WHEN success_us IS NOT NULL THEN 1 ELSE 0 END AS label_order_shipped,
           coalesce(success_us, last_us + 60 * {_DAY}) AS terminal_us,
           CASE WHEN success_us IS NOT NULL THEN 'success' ELSE 'inactive_60d' END AS journey_terminal_reason
    FROM (SELECT id, min(us) AS start_us, max(us) AS last_us, min(CASE WHEN ed_id = 28 THEN us END) AS success_us
          FROM {b} GROUP BY id)))"""),
        f"{b}_o": ((f"{b}_c", "defs"), f"""{b}_o AS (
  SELECT e.id, e.us, e.ed_id, d.milestone_number,
         row_number() OVER (PARTITION BY e.id ORDER BY e.us, e.ed_id) AS rn_first,
         row_number() OVER (PARTITION BY e.id ORDER BY e.us DESC, e.ed_id DESC) AS rn_last
  FROM {b} e JOIN {b}_c c ON e.id = c.id LEFT JOIN defs d ON d.ed_id = e.ed_id
  WHERE e.us <= c.cutoff_us)"""),
        f"{b}_g": ((f"{b}_o",), f"""{b}_g AS (
  SELECT o.id, CAST(count(*) AS BIGINT) AS n_events_observed,
       CAST(count(DISTINCT o.ed_id) AS BIGINT) AS n_unique_event_types_observed,
       max(CASE WHEN rn_first = 1 THEN o.us END) AS first_us, max(CASE WHEN rn_first = 1 THEN o.ed_id END) AS first_ed_id,
       max(CASE WHEN rn_last = 1 THEN o.us END) AS last_us2, max(CASE WHEN rn_last = 1 THEN o.ed_id END) AS last_ed_id,
       max(o.milestone_number) AS max_milestone_seen, bool_or(o.ed_id = 28) AS leaked_success,
       {pivot}
  FROM {b}_o o GROUP BY o.id)"""),
        f"snap_{b}": ((f"{b}_g",), f"""snap_{b} AS (
  SELECT g.* EXCLUDE (first_us, last_us2),
       make_timestamp(c.cutoff_us) AS cutoff_time, make_timestamp(c.terminal_us) AS journey_terminal_time,
       c.journey_terminal_reason, c.label_order_shipped, c.sampling_weight_days,
       greatest((c.cutoff_us - g.first_us) / {float(_DAY)}, 0.0) AS observed_duration_days,
       greatest((c.cutoff_us - g.last_us2) / {float(_DAY)}, 0.0) AS days_since_last_event,
       CAST(hour(make_timestamp(c.cutoff_us)) AS INTEGER) AS cutoff_hour_utc,
       CAST(isodow(make_timestamp(c.cutoff_us)) - 1 AS INTEGER) AS cutoff_dayofweek_utc,
       CAST(month(make_timestamp(c.cutoff_us)) AS INTEGER) AS cutoff_month_utc,
       CAST(dayofyear(make_timestamp(c.cutoff_us)) AS INTEGER) AS cutoff_dayofyear_utc,
       f.event_name AS first_event_name, f.stage AS first_stage, l.event_name AS last_event_name, l.stage AS last_stage
  FROM {b}_g g JOIN {b}_c c ON g.id = c.id
  LEFT JOIN defs f ON f.ed_id = g.first_ed_id LEFT JOIN defs l ON l.ed_id = g.last_ed_id)"""),
    }


_CTE.update(_snapshot_ctes("j1"))
_CTE.update(_snapshot_ctes("j2"))


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named binding CTEs (and their dependencies), then ``extra``
    CTE text (without the leading comma)."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in _CTE[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [_CTE[n][1] for n in order]
    if extra.strip():
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
