"""Model fitting, calibration, tuning and scoring on Spark ML (inventory P1-P8, P13, P14,
R1, R2).

Fits are Spark ML estimators (distributed over the training DataFrame); probabilities come
back as a plain ``p`` column via ``vector_to_array``. The only driver-side values are model
parameters (coefficients, importances), whose size is the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.operators.sampling import stratified_folds


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def class_weights(df: DataFrame, label: str = "y", out: str = "w") -> DataFrame:
    """Balanced class weights n / (2 n_class) as a column (a join with the class totals)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    t = c.agg(F.sum("_nc").alias("_n"))
    w = c.crossJoin(t).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias(out))
    return df.join(w, label)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None,
                 balanced: bool = False, scale: bool = False, reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Logistic regression; ``balanced`` adds n / (2 n_class) weights, ``scale`` a
    standard scaler (population-free: Spark's sample std) in the pipeline."""
    if balanced:
        df, weight = class_weights(df, label, "_cw"), "_cw"
    stages = [_assembler(features)]
    feat = "features"
    if scale:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True))
        feat = "scaled"
    lr = LogisticRegression(featuresCol=feat, labelCol=label, regParam=reg, maxIter=max_iter)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[*stages, lr]).fit(df.withColumn(label, F.col(label).cast("double")))


def fit_forest(df: DataFrame, features: Sequence[str], label: str = "y", trees: int = 10, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest (10 trees, depth 10)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembler(features), rf]).fit(df.withColumn(label, F.col(label).cast("double")))


def fit_gbt(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, pos_weight: float | None = None,
            valid_col: str | None = None, iters: int = 100, depth: int = 6, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees with sample weights, a positive-class weight, and early
    stopping on a validation indicator column."""
    d = df.withColumn(label, F.col(label).cast("double"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if pos_weight is not None:
        w = w * F.when(F.col(label) == 1.0, F.lit(float(pos_weight))).otherwise(F.lit(1.0))
    d = d.withColumn("_w", w)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="_w", maxIter=iters, maxDepth=depth, stepSize=step, seed=seed)
    if valid_col:
        gbt.setValidationIndicatorCol(valid_col)
    return Pipeline(stages=[_assembler(features), gbt]).fit(d)


def fit_mlp(df: DataFrame, features: Sequence[str], label: str = "y", hidden: Sequence[int] = (32, 16), iters: int = 100, seed: int = 42) -> PipelineModel:
    """P5: dense network (multilayer perceptron, scaled inputs)."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    mlp = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[len(features), *hidden, 2], maxIter=iters, seed=seed)
    return Pipeline(stages=[_assembler(features), scaler, mlp]).fit(df.withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id",), out: str = "p") -> DataFrame:
    """Batch scoring: positive-class probability as a double column."""
    s = model.transform(df)
    return s.select(*keep, vector_to_array("probability")[1].alias(out))


def _oof_scores(df: DataFrame, fit, features: Sequence[str], label: str, folds: int, seed: int, key: str) -> DataFrame:
    f = stratified_folds(df, label, folds, seed, key)
    parts = []
    for k in range(folds):
        m = fit(f.where(F.col("fold") != k))
        parts.append(score(m, f.where(F.col("fold") == k), keep=[key, label]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibrate(df: DataFrame, features: Sequence[str], fit, method: str = "sigmoid", folds: int = 3, label: str = "y",
              seed: int = 42, key: str = "id") -> tuple[DataFrame, object]:
    """Cross-fitted calibration. Out-of-fold scores of the base model (``folds`` stratified
    folds) fit a sigmoid (Platt: logistic regression on the logit) or an isotonic map.
    Returns (calibrated out-of-fold scores, calibrator model)."""
    oof = _oof_scores(df, fit, features, label, folds, seed, key)
    eps = 1e-6
    pc = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    oof = oof.withColumn("_logit", F.log(pc / (1 - pc))).withColumn(label, F.col(label).cast("double"))
    if method == "sigmoid":
        cal = Pipeline(stages=[_assembler(["_logit"]), LogisticRegression(featuresCol="features", labelCol=label)]).fit(oof)
        res = score(cal, oof, keep=[key, label, "p"], out="p_calibrated")
    else:
        cal = Pipeline(stages=[_assembler(["p"]), IsotonicRegression(featuresCol="features", labelCol=label, predictionCol="p_calibrated")]).fit(oof)
        res = cal.transform(oof).select(key, label, "p", "p_calibrated")
    return res, cal


class BrierEvaluator(Evaluator):
    """Brier score of the positive-class probability (lower is better), computed as a
    distributed average."""

    def __init__(self, label: str = "y"):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        p = vector_to_array("probability")[1]
        return float(dataset.agg(F.avg((p - F.col(self.label)) ** 2)).first()[0])

    def isLargerBetter(self) -> bool:
        return False


def tune_gbt(df: DataFrame, features: Sequence[str], label: str = "y", trees: Sequence[int] = (10, 30),
             rates: Sequence[float] = (0.05, 0.2), depth: int = 4, seed: int = 42) -> DataFrame:
    """train/validation search over trees x learning rate minimising Brier.
    Returns one row per grid point (trees, rate, brier) -- best first."""
    d = df.withColumn(label, F.col(label).cast("double"))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxIter, list(trees)).addGrid(gbt.stepSize, list(rates)).build()
    tvs = TrainValidationSplit(estimator=Pipeline(stages=[_assembler(features), gbt]), estimatorParamMaps=grid,
                               evaluator=BrierEvaluator(label), trainRatio=0.8, seed=seed)
    m = tvs.fit(d)
    rows = [(int(pm[gbt.maxIter]), float(pm[gbt.stepSize]), float(b)) for pm, b in zip(grid, m.validationMetrics)]
    return df.sparkSession.createDataFrame(rows, "trees int, rate double, brier double").orderBy("brier")


def importance(model: PipelineModel, features: Sequence[str], k: int = 20) -> DataFrame:
    """Feature importances of a tree model, top k."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = _spark()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def coefficients(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """R2: coefficients of a linear model ranked by absolute size."""
    lr = model.stages[-1]
    rows = [(f, float(c), abs(float(c))) for f, c in zip(features, lr.coefficients.toArray().tolist())]
    rows.append(("intercept", float(lr.intercept), abs(float(lr.intercept))))
    df = _spark().createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("abs_coefficient").desc(), "feature")))  # one row per feature


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def ml_scorer(model: PipelineModel, out: str = "p"):
    """Wrap a fitted pipeline as a scorer (DataFrame -> DataFrame with ``p``) for explanation."""
    def s(df: DataFrame) -> DataFrame:
        t = model.transform(df)
        return t.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "scaled")

    return s


def markov_transitions(status: DataFrame, segment: str | None = None) -> DataFrame:
    """Three-state continuous-time chain (active -> success | unsuccessful, both absorbing).

    ``status`` has per journey: status (success / unsuccessful / ongoing) and the dwell time in
    the active state in microseconds (``active_us``; censored for ongoing journeys). Rates are
    transitions per active day; absorption probability into success = l_s / (l_s + l_u).
    Exposure is summed in exact integer microseconds, then converted once; the sum is a decimal of
    38 digits, as a long holds no more than 292,000 years of dwell time."""
    keys = [segment] if segment else []
    g = status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_journeys"),
        F.count_if(F.col("status") == "success").alias("n_to_success"),
        F.count_if(F.col("status") == "unsuccessful").alias("n_to_unsuccessful"),
        (F.sum(F.col("active_us").cast("decimal(28,0)")).cast("double") / 86400e6).alias("exposure_days"),
    )
    ls = F.col("n_to_success") / F.col("exposure_days")
    lu = F.col("n_to_unsuccessful") / F.col("exposure_days")
    return g.select(*keys, "n_journeys", "n_to_success", "n_to_unsuccessful", "exposure_days", ls.alias("rate_success"),
                    lu.alias("rate_unsuccessful"), F.try_divide(ls, ls + lu).alias("p_absorb_success"))


def fit_hazard(status: DataFrame, features: Sequence[str], event: str, max_iter: int = 50) -> PipelineModel:
    """Rate of moving to ``event`` (success / unsuccessful) by features: an exponential hazard,
    fitted as a Poisson regression of the event's indicator with the log of the active days as offset.

    The fit's equations make expected and observed events equal in total and along every feature.
    A dwell time under a second counts as one second."""
    d = _exposed(status).withColumn("_event", (F.col("status") == event).cast("double"))
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="_event", offsetCol="_offset", featuresCol="features",
                                      predictionCol="_expected", maxIter=max_iter, tol=1e-10)
    return Pipeline(stages=[_assembler(features), glm]).fit(d)


def _exposed(status: DataFrame) -> DataFrame:
    return status.withColumn("_offset", F.log(F.greatest(F.col("active_us"), F.lit(1_000_000)).cast("double") / 86400e6))


def hazard_rates(status: DataFrame, features: Sequence[str], events: Sequence[str] = ("success", "unsuccessful")) -> DataFrame:
    """``status`` with each event's rate per active day and expected count (``rate_<event>``,
    ``expected_<event>``), and ``p_absorb_<event>``, its rate's share: the chance that a journey
    with these features ends there."""
    out, own = _exposed(status), list(status.columns)
    for event in events:
        scored = fit_hazard(status, features, event).transform(out)
        out = scored.withColumn(f"expected_{event}", F.col("_expected")).withColumn(f"rate_{event}", F.col("_expected") / F.exp("_offset")).drop("features", "_expected")
    total = sum((F.col(f"rate_{e}") for e in events[1:]), F.col(f"rate_{events[0]}"))
    return out.select(*own, *[c for e in events for c in (F.col(f"expected_{e}"), F.col(f"rate_{e}"), F.try_divide(F.col(f"rate_{e}"), total).alias(f"p_absorb_{e}"))])


def stage_transition_matrix(events: DataFrame, defs: DataFrame, cols=None) -> DataFrame:
    """P14 (discrete): stage -> next stage transition probabilities from consecutive events
    before the first success; the last of them moves to 'success' (the journey reaches the
    success event) or 'ended'. Both are absorbing (self-loop 1)."""
    from journeyflow.operators.ordered import ordered_scan
    from journeyflow.operators.project import bounded_broadcast
    from journeyflow.operators.snapshot import journey_frame, open_prefix, with_us

    e = open_prefix(with_us(events))
    st = e.join(bounded_broadcast(defs).select("ed_id", F.coalesce("stage", F.lit("Unknown")).alias("stage")), "ed_id", "left")
    st = st.withColumn("stage", F.coalesce("stage", F.lit("Unknown")))
    st = st.withColumn("_neg", -F.col("us")).withColumn("_nev", -F.col("ed_id"))
    nx = ordered_scan(st, "id", "_neg", ["_nev"], prev=["stage"])  # previous in reverse order = next step
    fr = journey_frame(events).select("id", F.col("success_us").isNotNull().alias("_succ"))
    nx = nx.join(fr, "id").withColumn(
        "to_stage", F.coalesce(F.col("prev_stage"), F.when(F.col("_succ"), F.lit("success")).otherwise(F.lit("ended"))))
    counts = nx.groupBy(F.col("stage").alias("from_stage"), "to_stage").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("from_stage").agg(F.sum("n").alias("_t"))
    probs = counts.join(tot, "from_stage").select("from_stage", "to_stage", "n", (F.col("n") / F.col("_t")).alias("prob"))
    spark = events.sparkSession
    absorbing = spark.createDataFrame([("success", "success", 0, 1.0), ("ended", "ended", 0, 1.0)], "from_stage string, to_stage string, n long, prob double")
    return probs.unionByName(absorbing)


def absorption(matrix: DataFrame, absorbing: Sequence[str] = ("success", "ended")) -> DataFrame:
    """Exact absorption probabilities, the solution x of (I - Q) x = R with Q the moves among
    passing stages and R those into absorbing ones; one row per stage and absorbing state. A stage
    that cannot reach an absorbing state has probability 0. The matrix holds one row per pair of
    stages (the fixed event dimension has at most 28), so it is solved in one task."""
    names = list(absorbing)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        moves = {(i, j): p for i, j, p in zip(pdf["from_stage"], pdf["to_stage"], pdf["prob"], strict=True) if p > 0}
        reach = set(names)
        while more := {i for i, j in moves if j in reach} - reach:
            reach |= more
        stages = sorted(reach - set(names))
        q = np.array([[moves.get((i, j), 0.0) for j in stages] for i in stages]).reshape(len(stages), len(stages))
        r = np.array([[moves.get((i, j), 0.0) for j in names] for i in stages]).reshape(len(stages), len(names))
        x = np.linalg.solve(np.eye(len(stages)) - q, r)
        found = {(i, a): float(v) for i, row in zip(stages, x, strict=True) for a, v in zip(names, row, strict=True)}
        found |= {(a, a): 1.0 for a in names}
        rows = [(i, a, found.get((i, a), 0.0)) for i in sorted({*pdf["from_stage"], *names}) for a in names]
        return pd.DataFrame(rows, columns=["from_stage", "absorbed_in", "probability"])

    small = matrix.select("from_stage", "to_stage", "prob")
    return small.groupBy().applyInPandas(solve, "from_stage string, absorbed_in string, probability double")
