"""Catalogue: metrics (Q1-Q12), blends and tiers (P9-P12), explanation with the fixed logit
(R3-R7, D6, I10, I12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import explain as ex
from journeyflow.operators import metrics as mt
from journeyflow.operators import sampling as sm
from journeyflow.plans.common import sql_u
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.sources.bindings import FIXED_MODELS, scores

_LL = "-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))"


def _s(spark, sf):
    return scores(spark, sf)


def _m(spark, sf, m="m1", feats=False):
    return scores(spark, sf, (m,), with_features=feats).drop("model")


@query("q1_brier", sql=with_ctes("scores") + "SELECT model, avg((p - y) * (p - y)) AS brier FROM scores GROUP BY model")
def q1(spark, sf):
    return mt.brier(_s(spark, sf), group=["model"])


@query("q2_log_loss", sql=with_ctes("scores") + f"SELECT model, avg({_LL}) AS log_loss FROM scores GROUP BY model")
def q2(spark, sf):
    return mt.log_loss(_s(spark, sf), group=["model"])


_AUC = """, t AS (SELECT model, p, sum(CASE WHEN y = 1 THEN {w} ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE {w} END) AS neg
  FROM {src} GROUP BY model, p),
r AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM t)
SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc
FROM r GROUP BY model"""


@query("q3_roc_auc", sql=with_ctes("scores") + _AUC.format(w="1.0", src="scores"))
def q3(spark, sf):
    return mt.roc_auc(_s(spark, sf), group=["model"])


@query("q3_roc_auc_weighted", sql=with_ctes("scores") + _AUC.format(w="(1.0 + x1)", src="scores"))
def q3w(spark, sf):
    s = scores(spark, sf, with_features=True).withColumn("w", 1.0 + F.col("x1"))
    return mt.roc_auc(s, weight="w", group=["model"])


@query("q4_average_precision", sql=with_ctes("scores") + """, t AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY model, p),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t
      WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS average_precision FROM r GROUP BY model""")
def q4(spark, sf):
    return mt.average_precision(_s(spark, sf), group=["model"])


@query("q5_accuracy", sql=with_ctes("scores") + "SELECT model, avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY model")
def q5(spark, sf):
    return mt.accuracy(_s(spark, sf), 0.5, group=["model"])


@query("q5_weighted_accuracy", sql=with_ctes("scores") + """SELECT model, sum(CASE WHEN CAST(p >= 0.6 AS INTEGER) = y THEN 1.0 ELSE 0.0 END * (1.0 + 3.0 * y)) / sum(1.0 + 3.0 * y)
       AS weighted_accuracy FROM scores GROUP BY model""")
def q5w(spark, sf):
    s = _s(spark, sf).withColumn("w", 1.0 + 3.0 * F.col("y"))
    return mt.accuracy(s, 0.6, weight="w", group=["model"])


@query("q6_confusion", sql=with_ctes("m1") + """SELECT a.actual, b.predicted, CAST(count(m1.id) AS BIGINT) AS n
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) b(predicted)
LEFT JOIN m1 ON m1.y = a.actual AND CAST(m1.p >= 0.5 AS INTEGER) = b.predicted GROUP BY a.actual, b.predicted""")
def q6(spark, sf):
    return mt.confusion(_m(spark, sf), 0.5)


@query("q7_classification_report", sql=with_ctes("m1") + """, c AS (SELECT
  sum(CASE WHEN y = 0 AND p < 0.3 THEN 1.0 ELSE 0.0 END) AS c00, sum(CASE WHEN y = 0 AND p >= 0.3 THEN 1.0 ELSE 0.0 END) AS c01,
  sum(CASE WHEN y = 1 AND p < 0.3 THEN 1.0 ELSE 0.0 END) AS c10, sum(CASE WHEN y = 1 AND p >= 0.3 THEN 1.0 ELSE 0.0 END) AS c11 FROM m1),
k AS (SELECT
  CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0.0 END AS p1, CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0.0 END AS r1,
  CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p0, CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r0,
  c11 + c10 AS s1, c00 + c01 AS s0, c00, c11 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM k)
SELECT '1' AS label, p1 AS precision, r1 AS recall, f1 AS f1, s1 AS support FROM f
UNION ALL SELECT '0', p0, r0, f0, s0 FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', (p1 * s1 + p0 * s0) / (s0 + s1), (r1 * s1 + r0 * s0) / (s0 + s1), (f1 * s1 + f0 * s0) / (s0 + s1), s0 + s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (c00 + c11) / (s0 + s1), s0 + s1 FROM f""")
def q7(spark, sf):
    return mt.classification_report(_m(spark, sf), 0.3)


@query("q8_roc_curve", sql=with_ctes("scores") + """, t AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY model, p),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS totp, sum(neg) OVER (PARTITION BY model) AS totn FROM t
      WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, p AS threshold, fp / totn AS fpr, tp / totp AS tpr FROM r
UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM scores""")
def q8(spark, sf):
    return mt.roc_curve(_s(spark, sf), group=["model"])


_TS = [round(0.1 * i, 1) for i in range(1, 10)]


@query("q9_threshold_sweep", sql=with_ctes("scores") + "\nUNION ALL\n".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, avg(CASE WHEN CAST(p >= {t} AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores WHERE model = 'm2'"
    for t in _TS))
def q9(spark, sf):
    return mt.threshold_sweep(_m(spark, sf, "m2"), _TS)


_T1, _T2, _T3 = (0.1, 0.2, 0.3), (0.3, 0.4, 0.5), (0.5, 0.6, 0.7, 0.8)


def _grid_sql():
    rows = ", ".join(f"({a}, {b}, {c})" for a in _T1 for b in _T2 for c in _T3 if a < b < c)
    ll = lambda v: f"-(y * ln({max(v, 1e-6)}) + (1 - y) * ln({1 - max(v, 1e-6)}))"
    raw = "-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))"
    return with_ctes("m1") + f""", g(t1, t2, t3) AS (VALUES {rows}),
x AS (SELECT g.t1, g.t2, g.t3, m1.y, m1.p,
        CASE WHEN p < t1 THEN 0 WHEN p < t2 THEN 1 WHEN p < t3 THEN 2 ELSE 3 END AS tier FROM g CROSS JOIN m1),
v AS (SELECT *, CASE tier WHEN 0 THEN 0.0 WHEN 1 THEN 0.15 WHEN 2 THEN 0.5 ELSE p END AS tp,
        CASE tier WHEN 0 THEN {ll(0.0)} WHEN 1 THEN {ll(0.15)} WHEN 2 THEN {ll(0.5)} ELSE {raw} END AS tl, {raw} AS rl FROM x),
a AS (SELECT """ + mt_auc_sql() + """)
SELECT CAST(t1 AS DOUBLE) AS tier1_threshold, CAST(t2 AS DOUBLE) AS tier2_threshold, CAST(t3 AS DOUBLE) AS tier3_threshold,
       avg(tl) AS tiered_logloss, avg(rl) AS raw_logloss, any_value(a.auc) AS auc,
       CAST(count(*) FILTER (WHERE tier = 0) AS BIGINT) AS tier_0_count, CAST(count(*) FILTER (WHERE tier = 1) AS BIGINT) AS tier_1_count,
       CAST(count(*) FILTER (WHERE tier = 2) AS BIGINT) AS tier_2_count, CAST(count(*) FILTER (WHERE tier = 3) AS BIGINT) AS tier_3_count,
       avg(tp) AS pred_mean, stddev_pop(tp) AS pred_std
FROM v, a GROUP BY t1, t2, t3"""


def mt_auc_sql():
    return """(SELECT sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (
      SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (
        SELECT p, sum(CASE WHEN y = 1 THEN 1.0 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1.0 END) AS neg FROM m1 GROUP BY p))) AS auc"""


@query("q10_tier_grid_search", sql=_grid_sql())
def q10(spark, sf):
    return mt.tier_grid_search(_m(spark, sf), _T1, _T2, _T3)


@query("q11_cv_summary", sql=with_ctes("m1") + f""", f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT), id) - 1) % 5 AS fold FROM m1),
pf AS (SELECT fold, avg(CASE WHEN CAST(p >= 0.6 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM f GROUP BY fold)
SELECT CAST(count(*) AS BIGINT) AS n_folds, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std FROM pf""")
def q11(spark, sf):
    folds = sm.stratified_folds(_m(spark, sf), "y", 5, 42)
    return mt.cv_summary(mt.accuracy(folds, 0.6, group=["fold"]), "accuracy")


@query("q12_model_comparison", sql=with_ctes("scores") + f""", b AS (SELECT model, avg((p - y) * (p - y)) AS brier, avg({_LL}) AS log_loss,
   avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY model),
t AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY model, p),
r AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
       sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
       sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM t),
k AS (SELECT model, sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc,
       sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM r GROUP BY model)
SELECT b.model, brier, log_loss, roc_auc, average_precision, accuracy FROM b JOIN k ON b.model = k.model""")
def q12(spark, sf):
    return mt.model_comparison(_s(spark, sf))


@query("p9_seed_blend", sql=with_ctes("scores") + "SELECT id, avg(p) AS p_blend, CAST(count(*) AS BIGINT) AS n_models FROM scores GROUP BY id")
def p9(spark, sf):
    return mt.seed_blend(_s(spark, sf))


_W = """w AS (SELECT model, (1 / brier) / sum(1 / brier) OVER () AS weight, brier FROM (SELECT model, avg((p - y) * (p - y)) AS brier FROM scores GROUP BY model))"""


@query("p10_inverse_brier_blend", sql=with_ctes("scores", extra=_W) + """SELECT s.id, sum(w.weight * s.p) AS p_blend, sum(w.weight) AS weight_sum
FROM scores s JOIN w ON s.model = w.model GROUP BY s.id""")
def p10(spark, sf):
    return mt.inverse_brier_blend(_s(spark, sf))


@query("p10_blend_weights", sql=with_ctes("scores", extra=_W) + "SELECT model, brier, weight FROM w")
def p10w(spark, sf):
    return mt.blend_weights(_s(spark, sf))


@query("p11_tier_tpp", sql=with_ctes("m1") + "SELECT id, p, CASE WHEN p < 0.4 THEN 0.0 WHEN p < 0.6 THEN 0.15 WHEN p < 0.75 THEN 0.5 ELSE p END AS tiered FROM m1")
def p11(spark, sf):
    return mt.tier(_m(spark, sf).select("id", "p"), (0.4, 0.6, 0.75), (0.0, 0.15, 0.5, None))


@query("p11_tier_xgb", sql=with_ctes("scores") + "SELECT id, p, CASE WHEN p < 0.6 THEN 0.0 WHEN p < 0.7 THEN 0.15 WHEN p < 0.8 THEN 0.5 ELSE 0.8 END AS tiered FROM scores WHERE model = 'm3'")
def p11x(spark, sf):
    return mt.tier(_m(spark, sf, "m3").select("id", "p"), (0.6, 0.7, 0.8), (0.0, 0.15, 0.5, 0.8))


@query("p12_classify", sql=with_ctes("m1") + "SELECT id, y, p, CAST(p >= 0.6 AS INTEGER) AS y_hat FROM m1")
def p12(spark, sf):
    return mt.classify(_m(spark, sf), 0.6)


@query("c14_constant_prediction", sql=with_ctes("m1") + "SELECT id, 0.0 AS order_shipped FROM m1")
def c14(spark, sf):
    from journeyflow.operators.project import constant_prediction

    return constant_prediction(_m(spark, sf), 0.0)


# --- explanation with the fixed logit m1 over x1..x5 ------------------------------------
_B0, _WS = FIXED_MODELS["m1"]
_WMAP = {f"x{i + 1}": w for i, w in enumerate(_WS)}
_Z = " + ".join([str(_B0)] + [f"{w} * {c}" for c, w in _WMAP.items()])
_ZG = lambda f: " + ".join([str(_B0)] + [f"{w} * {('g' if c == f else c)}" for c, w in _WMAP.items()])


def _scorer():
    return ex.logit_scorer(_B0, _WMAP)


def _grid_sql_cte(feature, n, lo, hi, src="f"):
    lo_e = f"quantile_cont({feature}, {lo})" if lo is not None else f"min({feature})"
    hi_e = f"quantile_cont({feature}, {hi})" if hi is not None else f"max({feature})"
    return f"""e AS (SELECT CAST({lo_e} AS DOUBLE) AS lo, CAST({hi_e} AS DOUBLE) AS hi FROM {src}),
grid AS (SELECT DISTINCT lo + CAST(i AS DOUBLE) * ((hi - lo) / {float(n - 1)}) AS g FROM e, range(0, {n}) t(i))"""


@query("r3_pdp", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'),
{_grid_sql_cte('x1', 30, 0.05, 0.95)}
SELECT g AS grid_value, avg(round(1 / (1 + exp(-({_ZG('x1')}))), 6)) AS pdp, CAST(count(*) AS BIGINT) AS n_rows FROM f CROSS JOIN grid GROUP BY g""")
def r3(spark, sf):
    f = _m(spark, sf, "m1", True)
    _, pdp = ex.pdp_ice(f, _scorer(), "x1", 30, 100, 42)
    return pdp


@query("r3_ice", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'),
{_grid_sql_cte('x4', 12, 0.05, 0.95)},
s AS (SELECT * FROM f ORDER BY {sql_u('id')}, id LIMIT 50)
SELECT id, g AS grid_value, round(1 / (1 + exp(-({_ZG('x4')}))), 6) AS p FROM s CROSS JOIN grid""")
def r3i(spark, sf):
    f = _m(spark, sf, "m1", True)
    ice, _ = ex.pdp_ice(f, _scorer(), "x4", 12, 50, 42)
    return ice


_REF = f"""ref AS (SELECT * FROM f ORDER BY abs(p - 0.5), id LIMIT 1)"""


@query("r4_cp_numeric", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'), {_REF},
{_grid_sql_cte('x2', 60, 0.02, 0.98)},
gg AS (SELECT g FROM grid UNION SELECT x2 FROM ref)
SELECT 'nearest_half' AS profile_name, ref.id, 'x2' AS feature, gg.g AS feature_value,
       round(1 / (1 + exp(-({_ZG('x2')}))), 6) AS predicted_success_probability, ref.x2 AS reference_value
FROM ref CROSS JOIN gg""")
def r4(spark, sf):
    f = _m(spark, sf, "m1", True)
    from journeyflow.operators.stats import nearest

    row = nearest(f, "p", 0.5, 1, ["id"])
    return ex.cp_numeric(f, _scorer(), row, "x2", 60, 0.02, 0.98, profile="nearest_half")


@query("r4_cp_numeric_minmax", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'),
ref AS (SELECT * FROM f WHERE y = 1 ORDER BY p DESC, id LIMIT 1),
{_grid_sql_cte('x1', 100, None, None)},
gg AS (SELECT g FROM grid UNION SELECT x1 FROM ref)
SELECT 'surest_success' AS profile_name, ref.id, 'x1' AS feature, gg.g AS feature_value,
       round(1 / (1 + exp(-({_ZG('x1')}))), 6) AS predicted_success_probability, ref.x1 AS reference_value
FROM ref CROSS JOIN gg""")
def r4b(spark, sf):
    f = _m(spark, sf, "m1", True)
    row = f.where("y = 1").orderBy(F.col("p").desc(), "id").limit(1)
    return ex.cp_numeric(f, _scorer(), row, "x1", 100, None, None, profile="surest_success")


_STAGES = ("Apply for Credit", "Credit Account", "Discover", "Downpayment", "First Purchase", "Prospecting")
_STAGE_W = dict(zip(_STAGES, (0.3, 0.9, -0.4, 1.2, 0.6, -0.8)))


def _stage_col(s):
    return "st_" + s.lower().replace(" ", "_")


@query("r5_cp_categorical", sql=with_ctes("snap_j2") + """, f AS (SELECT id, ln(1 + n_events_observed) AS x1, last_stage FROM snap_j2),
ref AS (SELECT * FROM f ORDER BY id LIMIT 1),
c(category, w) AS (VALUES """ + ", ".join(f"('{_stage_col(s)}', {w})" for s, w in _STAGE_W.items()) + """)
SELECT 'first_id' AS profile_name, ref.id, c.category, round(1 / (1 + exp(-(-1.0 + 0.5 * ref.x1 + c.w))), 6) AS predicted_success_probability,
       CAST(rank() OVER (ORDER BY round(1 / (1 + exp(-(-1.0 + 0.5 * ref.x1 + c.w))), 6) DESC, c.category) AS INTEGER) AS rank
FROM ref CROSS JOIN c""")
def r5(spark, sf):
    from journeyflow.operators import prep, snapshot as snap
    from journeyflow.plans.common import defs, ev

    s = snap.snapshot(ev(spark, sf, "j2"), defs(spark)).select("id", F.log1p(F.col("n_events_observed").cast("double")).alias("x1"), "last_stage")
    s = s.withColumn("last_stage", F.regexp_replace(F.lower("last_stage"), " ", "_"))
    oh = prep.one_hot(s, ["last_stage"], values={"last_stage": [c[3:] for c in map(_stage_col, _STAGES)]})
    oh = oh.withColumnsRenamed({f"last_stage_{c[3:]}": c for c in map(_stage_col, _STAGES)})
    row = oh.orderBy("id").limit(1)
    weights = {"x1": 0.5, **{_stage_col(s_): w for s_, w in _STAGE_W.items()}}
    return ex.cp_categorical(row, ex.logit_scorer(-1.0, weights), [_stage_col(s_) for s_ in _STAGES], profile="first_id").select(
        "profile_name", "id", "category", "predicted_success_probability", F.col("rank").cast("int").alias("rank"))


@query("r6_shapley_linear", sql=with_ctes("scores") + """, f AS (SELECT * FROM scores WHERE model = 'm1'),
m AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}" for c in _WMAP) + """ FROM f)
SELECT feature, avg(abs(phi)) AS mean_abs_shap FROM (
""" + "\n  UNION ALL\n".join(f"  SELECT '{c}' AS feature, {w} * ({c} - m_{c}) AS phi FROM f, m" for c, w in _WMAP.items()) + """) GROUP BY feature""")
def r6(spark, sf):
    _, rank = ex.shapley_linear(_m(spark, sf, "m1", True), _B0, _WMAP)
    return rank


@query("r7_observation_report", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'), {_REF}
SELECT id, feature, value FROM ref UNPIVOT (value FOR feature IN ({", ".join(_WMAP)}))""")
def r7(spark, sf):
    from journeyflow.operators.stats import nearest

    f = _m(spark, sf, "m1", True)
    row = nearest(f, "p", 0.5, 1, ["id"])
    return ex.observation_report(f, row, list(_WMAP))


@query("i10_interpolate", sql=with_ctes("scores") + f""", f AS (SELECT * FROM scores WHERE model = 'm1'), {_REF},
{_grid_sql_cte('x2', 7, 0.02, 0.98)},
c AS (SELECT g AS cx, round(1 / (1 + exp(-({_ZG('x2')}))), 6) AS cy FROM ref CROSS JOIN grid),
q AS (SELECT x2 AS x FROM f),
j AS (SELECT q.x, max({{'cx': cx, 'cy': cy}}) FILTER (WHERE cx <= q.x) AS lo, min({{'cx': cx, 'cy': cy}}) FILTER (WHERE cx >= q.x) AS hi
      FROM q CROSS JOIN c GROUP BY q.x)
SELECT 'nearest_half' AS profile_name, x,
       CASE WHEN lo IS NULL THEN hi.cy WHEN hi IS NULL THEN lo.cy WHEN hi.cx = lo.cx THEN lo.cy
            ELSE lo.cy + (x - lo.cx) * (hi.cy - lo.cy) / (hi.cx - lo.cx) END AS interpolated FROM j""")
def i10(spark, sf):
    from journeyflow.operators.stats import nearest

    f = _m(spark, sf, "m1", True)
    row = nearest(f, "p", 0.5, 1, ["id"])
    curve = ex.cp_numeric(f, _scorer(), row.drop("x2").crossJoin(row.select("x2")), "x2", 7, 0.02, 0.98, profile="nearest_half")
    curve = curve.where(F.col("feature_value").isNotNull())
    grid_only = curve.join(ex.linspace_grid(f, "x2", 7, 0.02, 0.98).select(F.col("grid_value").alias("feature_value")), "feature_value", "left_semi")
    pts = f.select(F.lit("nearest_half").alias("profile_name"), F.col("x2").alias("x")).distinct()
    return ex.interpolate(grid_only, pts, "profile_name", at="x")


@query("q7_classification_report_weighted", sql=with_ctes("scores") + """, m AS (SELECT y, p, 1.0 + x3 AS w FROM scores WHERE model = 'm2'),
c AS (SELECT
  sum(CASE WHEN y = 0 AND p < 0.4 THEN w ELSE 0.0 END) AS c00, sum(CASE WHEN y = 0 AND p >= 0.4 THEN w ELSE 0.0 END) AS c01,
  sum(CASE WHEN y = 1 AND p < 0.4 THEN w ELSE 0.0 END) AS c10, sum(CASE WHEN y = 1 AND p >= 0.4 THEN w ELSE 0.0 END) AS c11 FROM m),
k AS (SELECT
  CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0.0 END AS p1, CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0.0 END AS r1,
  CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p0, CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r0,
  c11 + c10 AS s1, c00 + c01 AS s0, c00, c11 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM k)
SELECT '1' AS label, p1 AS precision, r1 AS recall, f1 AS f1, s1 AS support FROM f
UNION ALL SELECT '0', p0, r0, f0, s0 FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', (p1 * s1 + p0 * s0) / (s0 + s1), (r1 * s1 + r0 * s0) / (s0 + s1), (f1 * s1 + f0 * s0) / (s0 + s1), s0 + s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (c00 + c11) / (s0 + s1), s0 + s1 FROM f""")
def q7w(spark, sf):
    s = scores(spark, sf, ("m2",), with_features=True).withColumn("w", 1.0 + F.col("x3"))
    return mt.classification_report(s, 0.4, weight="w")
