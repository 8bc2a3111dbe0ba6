"""Catalogue: what fitted models must satisfy exactly, so that SQL can tell it.

A likelihood fit with an intercept makes the weighted residuals orthogonal to every input; an
isotonic map's levels are the means of their rows; a loaded model scores as the saved one. Each
query returns such facts about a fit on the whole table beside counts that SQL derives anew.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from journeyflow.operators import ensemble as en
from journeyflow.operators import metrics as mt
from journeyflow.operators import models as md
from journeyflow.operators.sampling import stratified_split
from journeyflow.plans.q_models import _X, _train
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.session import ensure_checkpoint_dir

_U = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT), id"


def _fold_sql(folds: int, seeds, facts: str) -> str:
    """Rows, positives and true facts of every seed and fold."""
    per = [f"""SELECT CAST({s} AS INTEGER) AS seed, CAST((row_number() OVER (PARTITION BY y ORDER BY {_U.format(seed=s)}) - 1) % {folds} AS INTEGER) AS fold, y FROM m1""" for s in seeds]
    return with_ctes("m1") + f""", f AS ({' UNION ALL '.join(per)})
SELECT seed, fold, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, {facts} FROM f GROUP BY seed, fold"""


def _valid_sql(facts: str) -> str:
    return with_ctes("m1") + f""", s AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_U.format(seed=42)}) <= ceil(0.2 * count(*) OVER (PARTITION BY y)) AS valid FROM m1)
SELECT id, y, {facts} FROM s WHERE valid"""


def _logistic():
    return Pipeline(stages=[md._assembler(_X), LogisticRegression(labelCol="y")])


def _boosted():
    return Pipeline(stages=[md._assembler(_X), GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, subsamplingRate=0.7)])


def _close(c, scale: float = 1e-5):
    return F.abs(c) < scale


@query("p6_calibration_equations", sql=_fold_sql(3, [42], "TRUE AS mean_matches, TRUE AS logit_matches"))
def p6e(spark, sf):
    d = _train(spark, sf)
    held = en.CalibratedEnsemble(base=_logistic(), method="sigmoid", folds=3).fit(d).held_out(d)
    r = F.col("p") - F.col("y")
    return held.groupBy("seed", "fold").agg(
        F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_positive"),
        _close(F.avg(r)).alias("mean_matches"), _close(F.avg(r * en.logit(F.col("p_raw")))).alias("logit_matches"))


@query("p7_calibration_equations", sql=_fold_sql(5, [42], "TRUE AS mean_matches, TRUE AS levels_match, TRUE AS rises"))
def p7e(spark, sf):
    d = _train(spark, sf)
    held = en.CalibratedEnsemble(base=_logistic(), method="isotonic", folds=5).fit(d).held_out(d)
    levels = held.groupBy("seed", "fold", F.round("p", 12).alias("level")).agg(
        F.count("*").alias("n"), F.sum("y").alias("s"), F.sum("p").alias("t"), F.min("p_raw").alias("lo"), F.max("p_raw").alias("hi"))
    # a map that rises has as many levels whether cut by value or by raw score: no two levels' ranges meet
    other = levels.select("seed", "fold", F.col("level").alias("l2"), F.col("lo").alias("lo2"))
    crossed = levels.join(other, ["seed", "fold"]).where((F.col("l2") > F.col("level")) & (F.col("lo2") <= F.col("hi"))).select("seed", "fold").distinct()
    out = levels.groupBy("seed", "fold").agg(
        F.sum("n").alias("n_rows"), F.sum("s").cast("long").alias("n_positive"), _close((F.sum("t") - F.sum("s")) / F.sum("n")).alias("mean_matches"),
        F.bool_and(_close((F.col("t") - F.col("s")) / F.col("n"))).alias("levels_match"))
    return out.join(crossed.withColumn("x", F.lit(True)), ["seed", "fold"], "left").select("seed", "fold", "n_rows", "n_positive", "mean_matches", "levels_match", F.col("x").isNull().alias("rises"))


def _saved(spark, model):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


@query("p6_calibrated_new_rows", sql=_valid_sql("TRUE AS in_unit, TRUE AS same_after_load"))
def p6n(spark, sf):
    """Rows outside the fit, scored by the ensemble and by the same one saved and loaded."""
    d = stratified_split(_train(spark, sf), "y", 0.2, 42)
    model = en.CalibratedEnsemble(base=_logistic(), method="sigmoid", folds=3).fit(d.where("split = 'train'"))
    again = _saved(spark, model).transform(model.transform(d.where("split = 'valid'")).withColumnRenamed("p", "first"))
    return again.select("id", "y", F.col("p").between(0, 1).alias("in_unit"), (F.col("p") == F.col("first")).alias("same_after_load"))


@query("p9_seed_refit", sql=_valid_sql("CAST(5 AS BIGINT) AS n_seeds, CAST(15 AS BIGINT) AS n_pairs, TRUE AS blend_is_mean, TRUE AS seeds_differ"))
def p9r(spark, sf):
    """Boosted trees refitted with five seeds, isotonic maps on three folds each, averaged; rows outside the fits."""
    d = stratified_split(_train(spark, sf), "y", 0.2, 42)
    seeds = [42, 43, 44, 45, 46]
    model = en.CalibratedEnsemble(base=_boosted(), method="isotonic", folds=3, seeds=seeds).fit(d.where("split = 'train'"))
    scored = model.transform(d.where("split = 'valid'").select("id", "y", *_X)).withColumnRenamed("p", "blend")
    for s in seeds:
        alone = model._copyValues(en.CalibratedEnsembleModel([x for x in model.pairs if x[0] == s]))
        scored = alone.transform(scored).withColumnRenamed("p", f"s{s}")
    each = [F.col(f"s{s}") for s in seeds]
    differ = scored.agg(F.bool_or(F.greatest(*each) > F.least(*each) + 1e-9).alias("seeds_differ"))  # one row
    return scored.crossJoin(differ).select(
        "id", "y", F.lit(len({x[0] for x in model.pairs})).cast("long").alias("n_seeds"), F.lit(len(model.pairs)).cast("long").alias("n_pairs"),
        _close(F.col("blend") - sum(each[1:], each[0]) / len(each), 1e-12).alias("blend_is_mean"), "seeds_differ")


def _weighted(spark, sf):
    return _train(spark, sf).withColumn("w", 1.0 + 3.0 * F.col("y") + F.col("x1"))


def _oof(spark, sf):
    base = Pipeline(stages=[md._assembler(_X), LogisticRegression(labelCol="y", weightCol="w", tol=1e-10)])
    return en.cross_validate(_weighted(spark, sf), base, folds=5)


@query("q11_cross_validation", sql=_fold_sql(5, [42], "TRUE AS scored_once, TRUE AS other_fit").replace("SELECT seed, fold,", "SELECT fold,").replace("GROUP BY seed, fold", "GROUP BY fold"))
def q11c(spark, sf):
    """Every row scored once, by a weighted fit on the other folds: a fit that saw the fold would
    leave its weighted residuals together with the other folds' at zero."""
    oof = _oof(spark, sf)
    r = F.sum(F.col("w") * (F.col("p") - F.col("y"))) / F.sum("w")
    return oof.groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_positive"),
        (F.count_distinct("id") == F.count("*")).alias("scored_once"), (F.abs(r) > 1e-9).alias("other_fit"))


@query("q11_cross_validation_summary", sql=with_ctes("m1") + "SELECT CAST(5 AS BIGINT) AS n_folds, TRUE AS mean_matches, TRUE AS std_matches, TRUE AS better_than_one_class FROM (SELECT count(*) FROM m1)")
def q11s(spark, sf):
    oof = _oof(spark, sf)
    per = mt.accuracy(oof, 0.6, weight="w", group=["fold"])
    summary = mt.cv_summary(per, "weighted_accuracy")
    hit = ((F.col("p") >= 0.6).cast("int") == F.col("y")).cast("double")
    again = oof.groupBy("fold").agg((F.sum(hit * F.col("w")) / F.sum("w")).alias("a"), (F.sum(F.col("w") * (1 - F.col("y"))) / F.sum("w")).alias("none"))
    again = again.agg(F.avg("a").alias("m"), F.avg(F.col("a") * F.col("a")).alias("m2"), F.avg("none").alias("none"))  # one row
    spread = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))
    return summary.crossJoin(again).select("n_folds", _close(F.col("weighted_accuracy_mean") - F.col("m"), 1e-9).alias("mean_matches"), _close(F.col("weighted_accuracy_std") - spread, 1e-6).alias("std_matches"),
                                           (F.col("weighted_accuracy_mean") >= F.least("none", 1 - F.col("none"))).alias("better_than_one_class"))


def _equations(scored, weight, features):
    """Per input: whether the weighted residuals are orthogonal to it."""
    w, r = F.col(weight), F.col("p") - F.col("y")
    made = scored.agg(F.count("*").alias("n"), *[(F.sum(w * r * F.col(x)) / F.sum(w * (F.abs(F.col(x)) + 1))).alias(x) for x in features])  # one row
    return made.select(F.explode(F.array(*[F.struct(F.lit(x).alias("input"), F.col("n").alias("n_rows"), _close(F.col(x), 1e-4).alias("orthogonal")) for x in features])).alias("e")).select("e.*")


_INPUTS = ", ".join(f"('{x}')" for x in ["one", *_X])
_EQUATIONS = with_ctes("m1") + f"SELECT v.x AS input, (SELECT CAST(count(*) AS BIGINT) FROM m1) AS n_rows, TRUE AS orthogonal FROM (VALUES {_INPUTS}) v(x)"


@query("p1_score_equations", sql=_EQUATIONS)
def p1e(spark, sf):
    d = _train(spark, sf).withColumn("one", F.lit(1.0))
    return _equations(md.score(md.fit_logistic(d, _X), d, keep=["y", "one", *_X]), "one", ["one", *_X])


@query("p2_score_equations", sql=_EQUATIONS)
def p2e(spark, sf):
    d = md.class_weights(_train(spark, sf).withColumn("one", F.lit(1.0)))
    return _equations(md.score(md.fit_logistic(d, _X, balanced=True, scale=True), d, keep=["y", "one", "w", *_X]), "w", ["one", *_X])


_QUALITY = with_ctes("m1") + "SELECT CAST(count(*) AS BIGINT) AS n_rows, TRUE AS in_unit, TRUE AS separates, TRUE AS ranks FROM m1"


def _quality(scored):
    """Facts of a fit that learnt something: positives score higher on average, and rank higher."""
    of = {k: F.avg(F.when(F.col("y") == k, F.col("p"))) for k in (0, 1)}
    point = scored.agg(F.count("*").alias("n_rows"), F.bool_and(F.col("p").between(0, 1)).alias("in_unit"), (of[1] > of[0]).alias("separates"))
    return point.crossJoin(mt.roc_auc(scored)).select("n_rows", "in_unit", "separates", (F.col("roc_auc") > 0.7).alias("ranks"))  # one row each


@query("p3_forest_quality", sql=_QUALITY)
def p3q(spark, sf):
    d = _train(spark, sf)
    return _quality(md.score(md.fit_forest(d, _X), d, keep=["y"]))


@query("p4_gbt_quality", sql=_QUALITY)
def p4q(spark, sf):
    d = stratified_split(_train(spark, sf), "y", 0.2, 42).withColumn("is_valid", F.col("split") == "valid")
    return _quality(md.score(md.fit_gbt(d, _X, valid_col="is_valid", iters=20, depth=4), d, keep=["y"]))


@query("p5_mlp_quality", sql=_QUALITY)
def p5q(spark, sf):
    d = _train(spark, sf)
    return _quality(md.score(md.fit_mlp(d, _X, hidden=(16, 8), iters=50), d, keep=["y"]))


@query("p8_search_six_parameters", sql=with_ctes("m1") + """SELECT CAST(v.t AS INTEGER) AS trial, TRUE AS in_range, TRUE AS scored, TRUE AS best_is_least
FROM (VALUES (0), (1), (2), (3)) v(t), (SELECT count(*) FROM m1)""")
def p8s(spark, sf):
    """Four trials over all six parameters (few trees each), two rounds of halving on the whole table."""
    trials = en.draw_trials(4, ranges={"maxIter": (2, 6, True, False), "maxDepth": (3, 5, True, False)})
    t = en.search_gbt(_train(spark, sf), _X, trials, rounds=2)
    top = t.agg(F.max("n_rounds").alias("most"), F.min(F.when(F.col("n_rounds") == 2, F.col("brier"))).alias("least"), F.count_if("best").alias("n_best"))  # one row
    held = F.lit(True)
    for name, (lo, hi, _, _) in en.SEARCH.items():
        if name != "maxIter":
            held = held & F.col(name).between(lo, hi)
    return t.crossJoin(top).select("trial", held.alias("in_range"), F.col("brier").between(0, 1).alias("scored"),
                                   ((F.col("n_best") == 1) & (~F.col("best") | ((F.col("brier") == F.col("least")) & (F.col("n_rounds") == F.col("most"))))).alias("best_is_least"))


@query("p13_saved_equals_memory", sql=with_ctes("m1") + "SELECT id, TRUE AS same FROM m1")
def p13e(spark, sf):
    """A11 + P13: a saved and loaded pipeline scores every row as the one in memory."""
    d = _train(spark, sf)
    model = md.fit_logistic(d, _X)
    first = md.score(model, d, keep=["id", *_X], out="first")
    return md.score(_saved(spark, model), first, keep=["id", "first"]).select("id", (F.col("p") == F.col("first")).alias("same"))


@query("r1_importance_facts", sql=with_ctes("m1") + "SELECT CAST(5 AS BIGINT) AS n_features, TRUE AS sums_to_one, TRUE AS none_negative FROM (SELECT count(*) FROM m1)")
def r1f(spark, sf):
    imp = md.importance(md.fit_forest(_train(spark, sf), _X), _X, 20)
    return imp.agg(F.count("*").alias("n_features"), _close(F.sum("importance") - 1, 1e-9).alias("sums_to_one"), (F.min("importance") >= 0).alias("none_negative"))


@query("r2_coefficient_facts", sql=with_ctes("m1") + "SELECT id, TRUE AS reproduced FROM m1")
def r2f(spark, sf):
    """The ranked coefficients reproduce every row's probability."""
    d = _train(spark, sf)
    model = md.fit_logistic(d, _X)
    table = md.coefficients(model, _X).agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("c"))  # one row of six numbers
    z = sum((F.col("c")[x] * F.col(x) for x in _X), F.col("c")["intercept"])
    return md.score(model, d, keep=["id", *_X]).crossJoin(table).select("id", _close(F.col("p") - 1 / (1 + F.exp(-z)), 1e-9).alias("reproduced"))
