"""Calibrated ensembles, cross-validation and search as Spark ML stages (inventory P6-P9, Q11).

`CalibratedEnsemble` is an Estimator over any Spark ML classifier or pipeline. For every seed and
fold it fits the base on the other folds and a calibration map (Platt's sigmoid or an isotonic
step function) on the fold left out. Its Model holds all these pairs, scores any rows with the
mean of the pairs' calibrated probabilities, in one pass without a shuffle, and is saved and
loaded through Spark ML persistence. Several seeds refit the base with each of them and deal the
folds anew (seed blending).

Folds are exact stratified folds by a stable hash of the row key (N6), so the fold a row was left
out of can be found again: `held_out` scores every training row by the pair that did not see it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.operators.sampling import stratified_folds
from journeyflow.session import ensure_checkpoint_dir

_EPS = 1e-6  # probabilities are kept this far from 0 and 1 before the logit


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(q / (1 - q))


def fold_table(df: DataFrame, label: str, folds: int, seed: int, key: str) -> DataFrame:
    """``df`` with its folds, checkpointed: the fits and scorings that follow read it many times."""
    ensure_checkpoint_dir(df.sparkSession)
    return stratified_folds(df, label, folds, seed, key).withColumn(label, F.col(label).cast("double")).checkpoint()


def seeded(base: Estimator, seed: int) -> Estimator:
    """A copy of an estimator (or of every stage of a pipeline) with this seed, where it has one."""
    if isinstance(base, Pipeline):
        return Pipeline(stages=[seeded(s, seed) if isinstance(s, Estimator) else s for s in base.getStages()])
    out = base.copy()
    if out.hasParam("seed"):
        out.set(out.getParam("seed"), seed)
    return out


def positive_probability(model, df: DataFrame, out: str) -> DataFrame:
    """``df`` and the model's probability of class 1; the other columns that the model adds go."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


class _EnsembleParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label column, 0 or 1", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "column that identifies a row", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weights of the calibration maps; empty for none", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the calibrated probability", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "sigmoid or isotonic", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "folds of each seed", TypeConverters.toInt)
    seeds = Param(Params._dummy(), "seeds", "seeds, each with models of its own", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="y", keyCol="id", weightCol="", outputCol="p", method="sigmoid", folds=3, seeds=[42])

    def _p(self, name: str):
        return self.getOrDefault(name)


class CalibratedEnsemble(Estimator, _EnsembleParams, MLReadable, MLWritable):
    """Estimator of a `CalibratedEnsembleModel`. Every fold needs a row; a fold of one class gives a constant map."""

    @keyword_only
    def __init__(self, *, base: Estimator | None = None, labelCol="y", keyCol="id", weightCol="", outputCol="p", method="sigmoid", folds=3, seeds=(42,)):
        super().__init__()
        given = dict(self._input_kwargs)
        self.base = given.pop("base", None)
        if "seeds" in given:
            given["seeds"] = list(given["seeds"])
        self._set(**given)

    def _calibration(self, held: DataFrame):
        weight = self._p("weightCol")
        if self._p("method") == "sigmoid":
            x = VectorAssembler(inputCols=["_logit"], outputCol="_x")
            stage = LogisticRegression(featuresCol="_x", labelCol=self._p("labelCol"), tol=1e-12, maxIter=300)
            held = x.transform(held.withColumn("_logit", logit(F.col("_raw"))))
        elif self._p("method") == "isotonic":
            stage = IsotonicRegression(featuresCol="_raw", labelCol=self._p("labelCol"), predictionCol="_cal")
        else:
            raise ValueError(f"method {self._p('method')}: sigmoid or isotonic")
        return (stage.setWeightCol(weight) if weight else stage).fit(held)

    def _fit(self, dataset: DataFrame) -> CalibratedEnsembleModel:
        pairs = []
        for seed in self._p("seeds"):
            dealt = fold_table(dataset, self._p("labelCol"), self._p("folds"), seed, self._p("keyCol"))
            for fold in range(self._p("folds")):
                fitted = seeded(self.base, seed).fit(dealt.where(F.col("fold") != fold))
                held = positive_probability(fitted, dealt.where(F.col("fold") == fold), "_raw")
                pairs.append((seed, fold, fitted, self._calibration(held)))
        return self._copyValues(CalibratedEnsembleModel(pairs))

    def copy(self, extra=None):
        out = super().copy(extra)
        out.base = self.base
        return out

    def write(self) -> MLWriter:
        return _Writer(self, {"base": self.base})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def _with_parts(cls, parts: dict, meta: dict):
        out = cls()
        out.base = parts["base"]
        return out


class CalibratedEnsembleModel(Model, _EnsembleParams, MLReadable, MLWritable):
    """Pairs (seed, fold, fitted base, calibration map); `transform` adds the mean calibrated probability."""

    def __init__(self, pairs: Sequence[tuple] = ()):
        super().__init__()
        self.pairs = list(pairs)

    def _calibrated(self, df: DataFrame, pair: tuple, out: str) -> DataFrame:
        """``df`` with ``_raw``, the base's probability, and ``out``, the calibrated one."""
        _, _, base, cal = pair
        raw = positive_probability(base, df, "_raw")
        if self._p("method") == "sigmoid":
            z = F.lit(float(cal.coefficients[0])) * logit(F.col("_raw")) + F.lit(float(cal.intercept))
            return raw.withColumn(out, 1 / (1 + F.exp(-z)))
        return cal.transform(raw).withColumnRenamed("_cal", out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # the bases add columns of their own; what is there under such a name waits aside
        made = {"features", "scaled", "rawPrediction", "probability", "prediction", "_raw", "_cal", self._p("outputCol")}
        aside = {c: f"_aside_{i}" for i, c in enumerate(dataset.columns) if c in made}
        scored = dataset.withColumnsRenamed(aside)
        own = scored.columns
        for i, pair in enumerate(self.pairs):
            scored = self._calibrated(scored, pair, f"_p_{i}").drop("_raw")
        mean = sum((F.col(f"_p_{i}") for i in range(1, len(self.pairs))), F.col("_p_0")) / len(self.pairs)
        kept = [F.col(c).alias({v: k for k, v in aside.items()}.get(c, c)) for c in own if aside.get(self._p("outputCol")) != c]
        return scored.select(*kept, mean.alias(self._p("outputCol")))

    def held_out(self, dataset: DataFrame) -> DataFrame:
        """Rows (seed, fold, key, label, p_raw, p): every row of the training table scored by each
        seed's pair that was fitted without it."""
        label, key = self._p("labelCol"), self._p("keyCol")
        parts, dealt = [], {}
        for pair in self.pairs:
            seed, fold = pair[:2]
            if seed not in dealt:
                dealt[seed] = fold_table(dataset, label, self._p("folds"), seed, key)
            one = self._calibrated(dealt[seed].where(F.col("fold") == fold), pair, "_out")
            parts.append(one.select(F.lit(seed).alias("seed"), "fold", key, label, F.col("_raw").alias("p_raw"), F.col("_out").alias("p")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def copy(self, extra=None):
        out = super().copy(extra)
        out.pairs = list(self.pairs)
        return out

    def write(self) -> MLWriter:
        parts = {f"{kind}-{i}": stage for i, pair in enumerate(self.pairs) for kind, stage in zip(("base", "map"), pair[2:], strict=True)}
        return _Writer(self, parts, {"pairs": [list(pair[:2]) for pair in self.pairs]})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def _with_parts(cls, parts: dict, meta: dict):
        return cls([(seed, fold, parts[f"base-{i}"], parts[f"map-{i}"]) for i, (seed, fold) in enumerate(meta["pairs"])])


class _Writer(MLWriter):
    """Saves an instance's params, and its parts as Spark ML stages in sub-folders."""

    def __init__(self, instance, parts: dict, meta: dict | None = None):
        super().__init__()
        self.instance, self.parts, self.meta = instance, parts, meta or {}

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"parts": list(self.parts), **self.meta})
        for name, stage in self.parts.items():
            stage.write().save(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = {name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", self.sparkSession) for name in meta["parts"]}
        out = self.cls._with_parts(parts, meta)
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


def cross_validate(df: DataFrame, base: Estimator, folds: int = 5, label: str = "y", seed: int = 42, key: str = "id") -> DataFrame:
    """Q11: the rows of ``df`` with fold and p, each scored by a model fitted on the other folds.

    Weights are the base's own weight column, which stays on the rows for weighted metrics."""
    dealt = fold_table(df, label, folds, seed, key)
    parts = []
    for fold in range(folds):
        fitted = seeded(base, seed).fit(dealt.where(F.col("fold") != fold))
        parts.append(positive_probability(fitted, dealt.where(F.col("fold") == fold), "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Search ranges of the boosted trees: (least, most, whole numbers, log scale).
SEARCH = {
    "maxDepth": (3, 10, True, False),
    "subsamplingRate": (0.5, 1.0, False, False),
    "featureShare": (0.5, 1.0, False, False),
    "minInstancesPerNode": (1, 10, True, False),
    "maxIter": (50, 300, True, False),
    "stepSize": (0.01, 0.2, False, True),
}


def draw_trials(n: int, seed: int = 42, ranges: dict | None = None) -> list[dict]:
    """``n`` settings drawn by a stable hash of (parameter, trial, seed)."""
    out = []
    for trial in range(n):
        one = {}
        for name, (lo, hi, whole, log) in (SEARCH | (ranges or {})).items():
            u = int(hashlib.md5(f"{name}|{trial}|{seed}".encode()).hexdigest()[:8], 16) / 2**32
            v = lo * (hi / lo) ** u if log else lo + u * (hi - lo + (1 if whole else 0))
            one[name] = min(int(v), hi) if whole else v
        out.append(one)
    return out


def search_gbt(df: DataFrame, features: Sequence[str], trials: Sequence[dict], rounds: int = 3, label: str = "y", seed: int = 42, key: str = "id") -> DataFrame:
    """Search over all six parameters of boosted trees, minimising the Brier score of calibrated
    probabilities. Returns (trial, the parameters, n_rounds, brier, best), a row per trial.

    All trials share one fold table: a last fold to be judged on, and one per round for the
    calibration map, the base being fitted on the others. After each round the better half of the
    trials go on (successive halving), so poor settings cost one fit; a trial's score is its mean,
    and the best is the one of least score among those that went all the way."""
    dealt = fold_table(df, label, rounds + 1, seed, key)
    judged = dealt.where(F.col("fold") == rounds)
    found: dict[int, list[float]] = {i: [] for i in range(len(trials))}
    alive = list(found)
    for r in range(rounds):
        for i in alive:
            t = trials[i]
            gbt = GBTClassifier(labelCol=label, maxDepth=t["maxDepth"], subsamplingRate=t["subsamplingRate"], featureSubsetStrategy=str(round(t["featureShare"], 6)),
                                minInstancesPerNode=t["minInstancesPerNode"], maxIter=t["maxIter"], stepSize=t["stepSize"], seed=seed)
            base = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), gbt])
            fitted = base.fit(dealt.where((F.col("fold") != r) & (F.col("fold") != rounds)))
            one = CalibratedEnsemble(base=base, labelCol=label, keyCol=key)
            cal = one._calibration(positive_probability(fitted, dealt.where(F.col("fold") == r), "_raw"))
            scored = one._copyValues(CalibratedEnsembleModel([(seed, r, fitted, cal)])).transform(judged)
            found[i].append(scored.agg(F.avg((F.col("p") - F.col(label)) ** 2)).first()[0])
        if r < rounds - 1:
            alive = sorted(alive, key=lambda i: (sum(found[i]) / len(found[i]), i))[: (len(alive) + 1) // 2]
    best = min(alive, key=lambda i: (sum(found[i]) / len(found[i]), i))
    names = list(SEARCH)
    rows = [(i, *[float(trials[i][n]) for n in names], len(s), sum(s) / len(s), i == best) for i, s in found.items()]
    return df.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{n} double" for n in names) + ", n_rounds int, brier double, best boolean")
