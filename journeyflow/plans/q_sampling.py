"""Catalogue: sampling and splitting (N1-N10), scaling / encoding / selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import features as fe
from journeyflow.operators import prep
from journeyflow.operators import sampling as sm
from journeyflow.operators import snapshot as snap
from journeyflow.operators.stats import safe_corr
from journeyflow.plans.common import defs, ev, sql_u
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.schema import EVENT_DEFINITIONS
from journeyflow.sources.bindings import scores

_UL = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT)"


def _m1(spark, sf):
    return scores(spark, sf, ("m1",)).select("id", "y", "p")


def _lens(spark, sf, b):
    return ev(spark, sf, b).groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"))


@query("n1_sample_fraction", sql=with_ctes("j2") + f"""SELECT id, CAST(count(*) AS BIGINT) AS n_actions FROM j2 GROUP BY id HAVING {sql_u('id')} < 0.3""")
def n1(spark, sf):
    return sm.sample_fraction(_lens(spark, sf, "j2"), 0.3, 42)


@query("n2_sample_n", sql=with_ctes("j1") + f"""SELECT id, CAST(count(*) AS BIGINT) AS n_actions FROM j1 GROUP BY id ORDER BY {sql_u('id')}, id LIMIT 100""")
def n2(spark, sf):
    return sm.sample_n(_lens(spark, sf, "j1"), 100, 42)


@query("n3_stratified_split", sql=with_ctes("m1") + f"""SELECT id, y, p, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_UL}, id)
       <= ceil(0.2 * count(*) OVER (PARTITION BY y)) THEN 'valid' ELSE 'train' END AS split FROM m1""")
def n3(spark, sf):
    return sm.stratified_split(_m1(spark, sf), "y", 0.2, 42)


@query("n4_split", sql=with_ctes("j2") + f""", t AS (SELECT id, CAST(count(*) AS BIGINT) AS n_actions FROM j2 GROUP BY id)
SELECT id, n_actions, CASE WHEN row_number() OVER (ORDER BY {_UL}, id) <= ceil(0.2 * count(*) OVER ()) THEN 'valid' ELSE 'train' END AS split FROM t""")
def n4(spark, sf):
    return sm.split(_lens(spark, sf, "j2"), 0.2, 42)


@query("n5_id_split", sql=with_ctes("j1") + """, i AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'valid' END AS split
  FROM (SELECT DISTINCT id FROM j1))
SELECT j1.id, j1.event_timestamp, j1.ed_id, i.split FROM j1 JOIN i ON j1.id = i.id""")
def n5(spark, sf):
    e = ev(spark, sf, "j1").select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id")
    return sm.id_split(e, 0.8)


@query("n6_stratified_folds", sql=with_ctes("m1") + f"""SELECT id, y, p, CAST((row_number() OVER (PARTITION BY y ORDER BY {_UL}, id) - 1) % 5 AS INTEGER) AS fold FROM m1""")
def n6(spark, sf):
    return sm.stratified_folds(_m1(spark, sf), "y", 5, 42)


@query("n7_resample_to_rate", sql=with_ctes("m1") + f""", c AS (SELECT count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM m1)
SELECT id, y, p FROM m1 WHERE y = 0
UNION ALL
SELECT id, y, p FROM (SELECT id, y, p, row_number() OVER (ORDER BY {_UL}, id) AS r FROM m1 WHERE y = 1), c
WHERE r <= least(np, greatest(1, floor(nn * 0.05 / 0.95)))""")
def n7(spark, sf):
    return sm.resample_to_rate(_m1(spark, sf), "y", 0.05, 42)


@query("n8_stratified_cap", sql=with_ctes("m1") + f""", s AS (SELECT y, count(*) AS n FROM m1 GROUP BY y),
t AS (SELECT sum(n) AS tot, arg_max(y, n) AS big FROM s),
q0 AS (SELECT y, CASE WHEN tot <= 500 THEN n ELSE floor(500 * n / tot) END AS q0, tot, big FROM s, t),
q AS (SELECT y, q0 + CASE WHEN y = big AND tot > 500 THEN 500 - (SELECT sum(q0) FROM q0) ELSE 0 END AS q FROM q0)
SELECT id, x.y, p FROM (SELECT m1.*, row_number() OVER (PARTITION BY m1.y ORDER BY {_UL}, id) AS r FROM m1) x JOIN q ON x.y = q.y WHERE r <= q""")
def n8(spark, sf):
    return sm.stratified_cap(_m1(spark, sf), 500, "y", 42)


@query("n9_balanced_validation", sql=with_ctes("m1") + f""", s AS (SELECT y, count(*) AS n FROM m1 GROUP BY y)
SELECT id, x.y, p FROM (SELECT m1.*, row_number() OVER (PARTITION BY m1.y ORDER BY {_UL}, id) AS r FROM m1) x JOIN s ON x.y = s.y
WHERE r <= least(s.n, CASE WHEN x.y = 1 THEN 20 ELSE 380 END)""")
def n9(spark, sf):
    return sm.balanced_validation(_m1(spark, sf), 400, 0.05, "y", 42)


@query("n10_subsample_split", sql=with_ctes("m1") + f""", v AS (SELECT id FROM m1 QUALIFY row_number() OVER (PARTITION BY y ORDER BY {_UL}, id)
       <= ceil(0.2 * count(*) OVER (PARTITION BY y))),
k AS (SELECT * FROM m1 WHERE id IN (SELECT id FROM v)),
s AS (SELECT y, count(*) AS n FROM k GROUP BY y)
SELECT id, x.y, p FROM (SELECT k.*, row_number() OVER (PARTITION BY k.y ORDER BY {_UL}, id) AS r FROM k) x JOIN s ON x.y = s.y
WHERE r <= least(s.n, CASE WHEN x.y = 1 THEN 5 ELSE 95 END)""")
def n10(spark, sf):
    m = _m1(spark, sf)
    stored = sm.stratified_split(m, "y", 0.2, 42).where("split = 'valid'")
    return sm.subsample_split(m, stored, 100, 0.05, "y", 42)


_SC = ("x1", "x2", "x3", "x4", "x5")


def _feat(spark, sf):
    return scores(spark, sf, ("m1",), with_features=True).select("id", "y", *_SC)


@query("m5_fit_scaler", sql=with_ctes("scores") + " SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in _SC) + " FROM scores WHERE model = 'm1'")
def m5(spark, sf):
    return prep.fit_scaler(_feat(spark, sf), _SC)


@query("m6_apply_scaler", sql=with_ctes("scores") + """, f AS (SELECT * FROM scores WHERE model = 'm1'),
tr AS (SELECT * FROM f WHERE """ + sql_u("id") + """ < 0.8),
st AS (SELECT """ + ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s" for c in _SC)
       + """ FROM tr)
SELECT id, y, """ + ", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in _SC) + " FROM f, st")
def m6(spark, sf):
    f = _feat(spark, sf)
    train = sm.sample_fraction(f, 0.8, 42)
    return prep.apply_scaler(f, prep.fit_scaler(train, _SC, floor=1e-6), _SC)


@query("m7_one_hot", sql=with_ctes("snap_j1") + """SELECT id, """ + ", ".join(
    f"CAST(coalesce(last_stage = '{v}', false) AS INTEGER) AS \"last_stage_{v}\"" for v in
    ("Apply for Credit", "Credit Account", "Discover", "Downpayment", "First Purchase", "Prospecting"))
       + ", CAST(last_stage IS NULL AS INTEGER) AS last_stage_nan FROM snap_j1")
def m7(spark, sf):
    s = snap.snapshot(ev(spark, sf, "j1"), defs(spark)).select("id", "last_stage")
    stages = sorted({r[4] for r in EVENT_DEFINITIONS}) + [None]
    return prep.one_hot(s, ["last_stage"], values={"last_stage": stages}, drop_prefixes=["last_stage_Order Shipped"])


@query("m8_index_categories", sql=with_ctes("snap_j2") + """SELECT id, first_event_name,
       CAST(coalesce(dense_rank() OVER (PARTITION BY first_event_name IS NULL ORDER BY first_event_name) * CASE WHEN first_event_name IS NULL THEN 0 ELSE 1 END, 0) AS INTEGER) AS first_event_name_code
FROM snap_j2""")
def m8(spark, sf):
    s = snap.snapshot(ev(spark, sf, "j2"), defs(spark)).select("id", "first_event_name")
    return prep.index_categories(s, ["first_event_name"])


def _importance(spark, sf):
    """Importance of each static feature: |corr(feature, label)| normalised to sum 1."""
    e = ev(spark, sf, "j2")
    stt = fe.static_features(snap.open_prefix(e), ids=e.select("id").distinct())
    lab = snap.label_journeys(e).select("id", "label_order_shipped")
    j = stt.join(lab, "id")
    one = j.agg(*[F.abs(safe_corr(F.col(n), F.col("label_order_shipped").cast("double"))).alias(n) for n in fe.STATIC_FEATURE_NAMES])
    long = one.unpivot([], list(fe.STATIC_FEATURE_NAMES), "feature", "importance").na.drop()
    tot = long.agg(F.sum("importance").alias("_t"))
    return long.crossJoin(tot).select("feature", (F.col("importance") / F.col("_t")).alias("importance"))


def _importance_sql():
    from journeyflow.plans.q_features import _OPEN, _STATIC

    names = fe.STATIC_FEATURE_NAMES
    return with_ctes("j2") + _OPEN.format(b="j2") + _STATIC.replace("{src}", "pe") + """,
lab AS (SELECT id, CAST(bool_or(ed_id = 28) AS DOUBLE) AS y FROM j2 GROUP BY id),
full_ AS (SELECT i.id, lab.y, """ + ", ".join(f"coalesce(sv.{n}, 0.0) AS {n}" for n in names) + """
  FROM (SELECT DISTINCT id FROM j2) i LEFT JOIN sv ON i.id = sv.id JOIN lab ON lab.id = i.id),
c AS (SELECT feature, importance FROM (SELECT """ + ", ".join(f"abs(corr({n}, y)) AS {n}" for n in names) + """ FROM full_)
  UNPIVOT (importance FOR feature IN (""" + ", ".join(names) + """)) WHERE importance IS NOT NULL AND NOT isnan(importance)),
imp AS (SELECT feature, importance / sum(importance) OVER () AS importance FROM c)"""


@query("m10_select_by_importance", sql=_importance_sql() + " SELECT feature, importance FROM imp WHERE importance > 1.25 * (SELECT avg(importance) FROM imp)")
def m10(spark, sf):
    return prep.select_by_importance(_importance(spark, sf), 1.25)


@query("m11_select_by_threshold", sql=_importance_sql() + " SELECT feature, importance FROM imp WHERE importance > 0.005")
def m11(spark, sf):
    return prep.select_by_threshold(_importance(spark, sf), 0.005)
