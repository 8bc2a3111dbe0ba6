"""Catalogue: fitted models (P1-P8, P13, P14, R1, R2, R6 sampled). Fits are randomised or
iterative, so most entries have no SQL oracle (rows-only check); the Markov transition
counts are exact aggregates and have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import explain as ex
from journeyflow.operators import models as md
from journeyflow.operators import snapshot as snap
from journeyflow.operators.sampling import stratified_split
from journeyflow.plans.common import defs, ev
from journeyflow.plans.q_features import _OPEN
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.sources.bindings import scores

_X = ["x1", "x2", "x3", "x4", "x5"]


def _train(spark, sf):
    return scores(spark, sf, ("m1",), with_features=True).drop("model", "p")


@query("p1_fit_logistic")
def p1(spark, sf):
    d = _train(spark, sf)
    return md.score(md.fit_logistic(d, _X), d)


@query("p2_fit_logistic_balanced")
def p2(spark, sf):
    d = _train(spark, sf)
    return md.coefficients(md.fit_logistic(d, _X, balanced=True, scale=True), _X)


@query("r2_coefficients")
def r2(spark, sf):
    d = _train(spark, sf)
    return md.coefficients(md.fit_logistic(d, _X), _X)


@query("p3_fit_forest")
def p3(spark, sf):
    d = _train(spark, sf)
    return md.score(md.fit_forest(d, _X), d)


@query("r1_importance")
def r1(spark, sf):
    d = _train(spark, sf)
    return md.importance(md.fit_forest(d, _X), _X, 20)


@query("p4_fit_gbt")
def p4(spark, sf):
    d = stratified_split(_train(spark, sf), "y", 0.2, 42).withColumn("is_valid", F.col("split") == "valid")
    m = md.fit_gbt(d, _X, pos_weight=4.0, valid_col="is_valid", iters=30, depth=4)
    return md.score(m, d)


@query("p5_fit_mlp")
def p5(spark, sf):
    d = _train(spark, sf)
    return md.score(md.fit_mlp(d, _X, hidden=(16, 8), iters=50), d)


def _lr_fit(df):
    return md.fit_logistic(df, _X)


@query("p6_calibrate_sigmoid")
def p6(spark, sf):
    res, _ = md.calibrate(_train(spark, sf), _X, _lr_fit, "sigmoid", 3)
    return res


@query("p7_calibrate_isotonic")
def p7(spark, sf):
    res, _ = md.calibrate(_train(spark, sf), _X, _lr_fit, "isotonic", 5)
    return res


@query("p8_tune_gbt")
def p8(spark, sf):
    return md.tune_gbt(_train(spark, sf), _X, trees=(5, 15), rates=(0.1, 0.3), depth=3)


@query("p13_score_saved_model")
def p13(spark, sf):
    """A11 + P13: fit, save to the checkpoint folder, load, score."""
    import uuid

    from journeyflow.session import ensure_checkpoint_dir
    from journeyflow.sources import files

    d = _train(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-model-{uuid.uuid4().hex}"
    files.save_model(md.fit_logistic(d, _X), path)
    return md.score(files.load_model(path), d)


@query("r6_shapley_permutation")
def r6p(spark, sf):
    d = _train(spark, sf)
    m = md.fit_logistic(d, _X)
    return ex.shapley_permutation(d, d, md.ml_scorer(m), _X, n_perm=6)


def _status(spark, sf, b):
    e = ev(spark, sf, b)
    st = snap.journey_status(e)
    fr = snap.journey_frame(e)
    end = e.agg(F.max("us").alias("end_us"))
    j = st.join(fr, "id").crossJoin(F.broadcast(end))
    until = (F.when(F.col("status") == "success", F.col("success_us"))
             .when(F.col("status") == "unsuccessful", F.col("last_us") + F.lit(60 * 86400 * 1000000))
             .otherwise(F.col("end_us")))
    return j.select("id", "status", (until - F.col("start_us")).alias("active_us"),
                    F.when(F.col("n_actions") >= 10, "long").otherwise("short").alias("segment"))


_CHAIN = with_ctes("j2") + """, f AS (SELECT id, min(us) AS s, max(us) AS l, min(CASE WHEN ed_id = 28 THEN us END) AS su, count(*) AS n
  FROM j2 GROUP BY id),
e AS (SELECT max(us) AS end_us FROM j2),
st AS (SELECT id, CASE WHEN su IS NOT NULL THEN 'success' WHEN end_us - l >= 60 * 86400000000 THEN 'unsuccessful' ELSE 'ongoing' END AS status,
       s, l, su, end_us, CASE WHEN n >= 10 THEN 'long' ELSE 'short' END AS segment FROM f, e),
a AS (SELECT segment, status, CASE status WHEN 'success' THEN su WHEN 'unsuccessful' THEN l + 60 * 86400000000 ELSE end_us END - s AS active_us FROM st)"""


@query("p14_markov_transitions", sql=_CHAIN + """
SELECT segment, CAST(count(*) AS BIGINT) AS n_journeys, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS n_to_success,
       CAST(count(*) FILTER (WHERE status = 'unsuccessful') AS BIGINT) AS n_to_unsuccessful, CAST(sum(active_us) AS DOUBLE) / 86400e6 AS exposure_days,
       count(*) FILTER (WHERE status = 'success') / (CAST(sum(active_us) AS DOUBLE) / 86400e6) AS rate_success,
       count(*) FILTER (WHERE status = 'unsuccessful') / (CAST(sum(active_us) AS DOUBLE) / 86400e6) AS rate_unsuccessful,
       count(*) FILTER (WHERE status = 'success') / (count(*) FILTER (WHERE status = 'success') + count(*) FILTER (WHERE status = 'unsuccessful')) AS p_absorb_success
FROM a GROUP BY segment""")
def p14(spark, sf):
    return md.markov_transitions(_status(spark, sf, "j2"), "segment")


@query("p14_hazard_by_features", sql=_CHAIN + """
SELECT segment, CAST(count(*) AS BIGINT) AS n_journeys, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS n_success,
       CAST(count(*) FILTER (WHERE status = 'unsuccessful') AS BIGINT) AS n_unsuccessful, TRUE AS success_as_expected, TRUE AS unsuccessful_as_expected, TRUE AS shares_add_up
FROM a GROUP BY segment""")
def p14h(spark, sf):
    """Rates by segment and journey length: in every segment as many events are expected as observed."""
    size = snap.journey_frame(ev(spark, sf, "j2")).select("id", F.log("n_actions").alias("log_actions"))
    st = _status(spark, sf, "j2").join(size, "id").withColumn("is_long", (F.col("segment") == "long").cast("double"))
    r = md.hazard_rates(st, ["is_long", "log_actions"])
    close = {e: F.abs(F.sum(f"expected_{e}") - F.count_if(F.col("status") == e)) < 1e-4 * (F.count("*") + 1) for e in ("success", "unsuccessful")}
    return r.groupBy("segment").agg(
        F.count("*").alias("n_journeys"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "unsuccessful").alias("n_unsuccessful"),
        close["success"].alias("success_as_expected"), close["unsuccessful"].alias("unsuccessful_as_expected"),
        F.bool_and(F.abs(F.col("p_absorb_success") + F.col("p_absorb_unsuccessful") - 1) < 1e-9).alias("shares_add_up"))


_STAGE_MOVES = with_ctes("j1", "defs") + _OPEN.format(b="j1") + """, s AS (SELECT e.id, e.us, e.ed_id, coalesce(d.stage, 'Unknown') AS stage FROM pe e LEFT JOIN defs d ON e.ed_id = d.ed_id),
f AS (SELECT id, bool_or(ed_id = 28) AS succ FROM j1 GROUP BY id),
n AS (SELECT s.stage AS from_stage, coalesce(lead(s.stage) OVER (PARTITION BY s.id ORDER BY s.us, s.ed_id), CASE WHEN f.succ THEN 'success' ELSE 'ended' END) AS to_stage
      FROM s JOIN f ON s.id = f.id),
c AS (SELECT from_stage, to_stage, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY ALL)
SELECT from_stage, to_stage, n, n / sum(n) OVER (PARTITION BY from_stage) AS prob FROM c
UNION ALL SELECT 'success', 'success', 0, 1.0 UNION ALL SELECT 'ended', 'ended', 0, 1.0"""


@query("p14_stage_transitions", sql=_STAGE_MOVES)
def p14s(spark, sf):
    return md.stage_transition_matrix(ev(spark, sf, "j1"), defs(spark))


# the same probabilities as the limit of repeated steps, far beyond the slowest stage
@query("p14_absorption", sql=f"""WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM ({_STAGE_MOVES}) AS moves),
x(step, i, a, v) AS (
  SELECT 0, i.from_stage, a.from_stage, CAST(i.from_stage = a.from_stage AS DOUBLE)
  FROM (SELECT DISTINCT from_stage FROM m) i, (SELECT from_stage FROM m WHERE from_stage IN ('success', 'ended')) a
  UNION ALL
  SELECT x.step + 1, m.from_stage, x.a, sum(CAST(m.prob AS DOUBLE) * x.v) FROM x JOIN m ON m.to_stage = x.i
  WHERE x.step < 2000 GROUP BY x.step, m.from_stage, x.a)
SELECT i AS from_stage, a AS absorbed_in, v AS probability FROM x WHERE step = 2000""")
def p14a(spark, sf):
    return md.absorption(md.stage_transition_matrix(ev(spark, sf, "j1"), defs(spark)))
