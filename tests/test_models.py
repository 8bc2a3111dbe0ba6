"""Quality bounds for the fitted (rows-only) operators: Spark ML fits, calibration, tuning,
Markov absorption, PACF, GARCH, calendar forecast."""

import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from journeyflow.operators import metrics as mt
from journeyflow.operators import models as md
from journeyflow.operators import series as ts
from journeyflow.plans.common import defs, ev
from journeyflow.sources.bindings import daily_lines, scores

X = ["x1", "x2", "x3", "x4", "x5"]


@pytest.fixture(scope="module")
def train(spark):
    return scores(spark, SF_CHECK, ("m1",), with_features=True).drop("model", "p").cache()


def test_logistic_learns_signal(train):
    s = md.score(md.fit_logistic(train, X), train, keep=["id", "y"])
    assert mt.roc_auc(s).first().roc_auc > 0.7
    p = s.agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_gbt_with_early_stopping_and_weights(train):
    from journeyflow.operators.sampling import stratified_split

    d = stratified_split(train, "y", 0.2, 42).withColumn("is_valid", F.col("split") == "valid")
    s = md.score(md.fit_gbt(d, X, pos_weight=3.0, valid_col="is_valid", iters=20, depth=3), d, keep=["id", "y"])
    assert mt.roc_auc(s).first().roc_auc > 0.7


def test_forest_importances_sum_to_one(train):
    imp = md.importance(md.fit_forest(train, X, trees=5, depth=4), X, 20)
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_calibration_keeps_ranking_quality(train):
    res, _ = md.calibrate(train, X, lambda d: md.fit_logistic(d, X), "isotonic", 3)
    b_raw = mt.brier(res, "p", "y").first().brier
    b_cal = mt.brier(res, "p_calibrated", "y").first().brier
    assert b_cal <= b_raw + 1e-3


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_ensemble_scores_new_rows_and_is_saved(spark, train, tmp_path, method):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from journeyflow.operators import ensemble as en

    base = Pipeline(stages=[md._assembler(X), LogisticRegression(labelCol="y")])
    est = en.CalibratedEnsemble(base=base, method=method, folds=3, seeds=[1, 2])
    est.write().save(str(tmp_path / "estimator"))
    est = en.CalibratedEnsemble.load(str(tmp_path / "estimator"))
    old, new = train.where("hash(id) % 4 != 0"), train.where("hash(id) % 4 = 0")
    model = est.fit(old)
    assert len(model.pairs) == 6
    # columns named like the bases' own, and a null input
    clash = new.withColumn("features", F.lit("f")).withColumn("prediction", F.lit(7)).withColumn("x1", F.when(F.col("x1") > 3, None).otherwise(F.col("x1")))
    got = model.transform(clash.withColumn("p", F.lit("gone")))
    assert set(got.columns) == {*clash.columns, "p"} and got.count() == new.count()
    assert got.where("features = 'f' and prediction = 7").count() == new.count()
    model.write().save(str(tmp_path / "model"))
    again = en.CalibratedEnsembleModel.load(str(tmp_path / "model")).transform(new)
    both = model.transform(new).select("id", F.col("p").alias("a")).join(again.select("id", "p"), "id")
    assert both.where("a = p").count() == new.count()
    scored = model.transform(new)
    raw = md.score(md.fit_logistic(old, X), new, keep=["id", "y"])
    assert mt.brier(scored, "p", "y").first().brier <= mt.brier(raw, "p", "y").first().brier + 5e-3
    assert model.transform(new.limit(0)).count() == 0
    held = model.held_out(old)
    assert held.count() == 2 * old.count() and held.select("seed", "id").distinct().count() == held.count()


def test_tuning_grid_rows(train):
    t = md.tune_gbt(train, X, trees=(3, 6), rates=(0.1, 0.3), depth=2)
    rows = t.collect()
    assert len(rows) == 4 and rows[0].brier == min(r.brier for r in rows)


def test_absorption_rows_are_distributions(spark):
    a = md.absorption(md.stage_transition_matrix(ev(spark, SF_CHECK, "j1"), defs(spark)))
    tot = a.groupBy("from_stage").agg(F.sum("probability").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-6) for r in tot)


def test_pacf_lag0_and_bounds(spark):
    p = ts.pacf(daily_lines(spark, SF_CHECK), 10).collect()
    assert {r.lag for r in p} == set(range(11))
    assert all(abs(r.pacf) <= 1.0 + 1e-9 for r in p)


def test_garch_variance_positive(spark):
    g = ts.garch_grid(ts.decompose(daily_lines(spark, SF_CHECK)), 10).collect()
    assert len(g) == 10 and all(r.variance > 0 for r in g)


def test_calendar_forecast_weekends_zero(spark):
    f = ts.calendar_forecast(daily_lines(spark, SF_CHECK), 21)
    rows = f.withColumn("wd", F.weekday("date")).collect()
    assert all(r["mean"] == 0.0 for r in rows if r.wd >= 5)
    assert all(r.lower <= r["mean"] <= r.upper for r in rows)


def test_shapley_permutation_of_all_rows_sums_to_score_difference(spark, train):
    from journeyflow.plans.registry import all_queries

    scorer = md.ml_scorer(md.fit_logistic(train, X))
    at_mean = scorer(train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in X])).first().p
    got = all_queries()["r6_shapley_permutation"](spark, SF_CHECK)
    assert got.groupBy("feature").count().collect() and {r["count"] for r in got.groupBy("feature").count().collect()} == {train.count()}
    total = got.groupBy("id").agg(F.sum("phi").alias("phi")).join(scorer(train).select("id", "p"), "id", "full")
    assert total.where(F.abs(F.col("phi") - (F.col("p") - at_mean)) < 1e-6).count() == train.count() > 20
