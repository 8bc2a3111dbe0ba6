"""Evaluation metrics as distributed aggregations (inventory Q1-Q13) and score operators
(P9-P12).

Rank metrics (AUC, AP, ROC) first collapse rows to distinct scores per group (a partial +
final hash aggregate), then take prefix sums over the score order with the two-level ordered
scan (score bucket, then score), so no single task sees all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.functions.scalar import clip_prob
from journeyflow.operators.ordered import ordered_scan

_SCORE_BUCKET = 1.0 / 4096


def _g(group: Sequence[str]) -> list[str]:
    return list(group)


def brier(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Q1: mean squared error of the probability."""
    return df.groupBy(*_g(group)).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def log_loss_expr(p: str | Column, y: str | Column, eps: float = 1e-15) -> Column:
    pc = clip_prob(p, eps)
    yc = F.col(y) if isinstance(y, str) else y
    return -(yc * F.log(pc) + (1 - yc) * F.log(1 - pc))


def log_loss(df: DataFrame, p: str = "p", y: str = "y", eps: float = 1e-15, group: Sequence[str] = ()) -> DataFrame:
    """Q2: mean binary cross-entropy with probabilities clipped to [eps, 1 - eps]."""
    return df.groupBy(*_g(group)).agg(F.avg(log_loss_expr(p, y, eps)).alias("log_loss"))


def _score_table(df: DataFrame, p: str, y: str, weight: str | None, group: Sequence[str]) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*_g(group), F.col(p).alias("_s")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("_neg"),
    )


def _with_group_key(t: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return t, list(group)
    return t.withColumn("_all", F.lit(0)), ["_all"]


def roc_auc(df: DataFrame, p: str = "p", y: str = "y", weight: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Q3: area under the ROC curve (Mann-Whitney with ties = 1/2, optional weights);
    NULL when a group holds one class only."""
    t, keys = _with_group_key(_score_table(df, p, y, weight, group), group)
    s = ordered_scan(t, keys, "_s", [], running={"_cn": F.col("_neg")}, bucket_us=_SCORE_BUCKET)
    below = F.col("_cn") - F.col("_neg")
    g = s.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg"))).alias("_num"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_num") / (F.col("_P") * F.col("_N")))
    return g.select(*_g(group), auc.alias("roc_auc"))


def _desc_running(df: DataFrame, p: str, y: str, weight: str | None, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    t, keys = _with_group_key(_score_table(df, p, y, weight, group), group)
    t = t.withColumn("_ns", -F.col("_s"))
    s = ordered_scan(t, keys, "_ns", [], running={"_tp": F.col("_pos"), "_fp": F.col("_neg")}, bucket_us=_SCORE_BUCKET)
    return s, keys


def average_precision(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Q4: sum over distinct thresholds (high to low) of (recall step) x precision."""
    s, keys = _desc_running(df, p, y, None, group)
    g = s.groupBy(*keys).agg(F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_num"),
                             F.sum("_pos").alias("_P"))
    return g.select(*_g(group), F.when(F.col("_P") > 0, F.col("_num") / F.col("_P")).alias("average_precision"))


def roc_curve(df: DataFrame, p: str = "p", y: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Q8: (threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) start point."""
    s, keys = _desc_running(df, p, y, None, group)
    tot = s.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    j = s.join(tot, keys)
    pts = j.select(*_g(group), F.col("_s").alias("threshold"), (F.col("_fp") / F.col("_N")).alias("fpr"),
                   (F.col("_tp") / F.col("_P")).alias("tpr"))
    start = tot.select(*_g(group), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def accuracy(df: DataFrame, t: float = 0.5, p: str = "p", y: str = "y", weight: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Q5: (weighted) share of rows whose thresholded prediction equals the label."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = ((F.col(p) >= t).cast("int") == F.col(y)).cast("double")
    return df.groupBy(*_g(group)).agg((F.sum(hit * w) / F.sum(w)).alias("weighted_accuracy" if weight else "accuracy"))


def confusion(df: DataFrame, t: float = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """Q6: the full 2 x 2 matrix (actual, predicted, n), zero cells included."""
    g = df.agg(*[F.count_if((F.col(y) == a) & ((F.col(p) >= t).cast("int") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])
    return g.select(F.explode(cells).alias("c")).select("c.*")


def classification_report(df: DataFrame, t: float = 0.5, p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """Q7: precision, recall, F1 and support per class, plus macro and weighted averages and
    accuracy (rows labelled '0', '1', 'macro avg', 'weighted avg', 'accuracy')."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yh = (F.col(p) >= t).cast("int")
    g = df.agg(*[F.sum(F.when((F.col(y) == a) & (yh == b), w).otherwise(0.0)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k, o in ((1, 0), (0, 1)):
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        rows.append((str(k), prec, rec, f1, tp + fn))
    sup0, sup1 = rows[1][4], rows[0][4]
    tot = sup0 + sup1
    acc = (F.col("c00") + F.col("c11")) / tot
    out = [F.struct(F.lit(n).alias("label"), pr.alias("precision"), rc.alias("recall"), f.alias("f1"), s.alias("support")) for n, pr, rc, f, s in rows]
    out.append(F.struct(F.lit("macro avg").alias("label"), ((rows[0][1] + rows[1][1]) / 2).alias("precision"),
                        ((rows[0][2] + rows[1][2]) / 2).alias("recall"), ((rows[0][3] + rows[1][3]) / 2).alias("f1"), tot.alias("support")))
    out.append(F.struct(F.lit("weighted avg").alias("label"), ((rows[0][1] * sup1 + rows[1][1] * sup0) / tot).alias("precision"),
                        ((rows[0][2] * sup1 + rows[1][2] * sup0) / tot).alias("recall"),
                        ((rows[0][3] * sup1 + rows[1][3] * sup0) / tot).alias("f1"), tot.alias("support")))
    out.append(F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), acc.alias("f1"), tot.alias("support")))
    return g.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """Q9: accuracy at each threshold, one pass (one conditional aggregate per threshold)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs = [(F.sum(((F.col(p) >= t).cast("int") == F.col(y)).cast("double") * w) / F.sum(w)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("accuracy")) for i, t in enumerate(thresholds)])
    return one.select(F.explode(arr).alias("r")).select("r.*")


def tier(df: DataFrame, thresholds: Sequence[float], values: Sequence[float | None], p: str = "p", out: str = "tiered") -> DataFrame:
    """Tiered prediction: below thresholds[0] -> values[0], ..., at or above the last
    threshold -> values[-1] (None keeps the raw probability)."""
    def val(v):
        return F.col(p) if v is None else F.lit(float(v))

    e = val(values[-1])
    for t, v in reversed(list(zip(thresholds, values[:-1]))):
        e = F.when(F.col(p) < t, val(v)).otherwise(e)
    return df.withColumn(out, e)


def classify(df: DataFrame, t: float, p: str = "p", out: str = "y_hat") -> DataFrame:
    """Thresholded class (1 when p >= t)."""
    return df.withColumn(out, (F.col(p) >= t).cast("int"))


def seed_blend(scores: DataFrame, key: str = "id", p: str = "p") -> DataFrame:
    """Mean probability over refits (rows of several seeds/models per id)."""
    return scores.groupBy(key).agg(F.avg(p).alias("p_blend"), F.count(F.lit(1)).alias("n_models"))


def inverse_brier_blend(scores: DataFrame, model: str = "model", key: str = "id", p: str = "p", y: str = "y") -> DataFrame:
    """P10: weights w_m = (1/brier_m) / sum(1/brier); blended p = sum_m w_m p_m. The weight
    table has one row per model (broadcast)."""
    b = brier(scores, p, y, [model]).withColumn("_inv", 1.0 / F.col("brier"))
    tot = b.agg(F.sum("_inv").alias("_t"))
    w = b.crossJoin(tot).select(model, (F.col("_inv") / F.col("_t")).alias("weight"))
    j = scores.join(w, model)
    return j.groupBy(key).agg(F.sum(F.col("weight") * F.col(p)).alias("p_blend"), F.sum("weight").alias("weight_sum"))


def blend_weights(scores: DataFrame, model: str = "model", p: str = "p", y: str = "y") -> DataFrame:
    """P10: the inverse-Brier weight table itself."""
    b = brier(scores, p, y, [model]).withColumn("_inv", 1.0 / F.col("brier"))
    tot = b.agg(F.sum("_inv").alias("_t"))
    return b.crossJoin(tot).select(model, "brier", (F.col("_inv") / F.col("_t")).alias("weight"))


def tier_grid_search(df: DataFrame, t1: Sequence[float], t2: Sequence[float], t3: Sequence[float],
                     values: Sequence[float] = (0.0, 0.15, 0.5), p: str = "p", y: str = "y", eps: float = 1e-6) -> DataFrame:
    """Q10: evaluate every t1 < t2 < t3 of the grid: tiered and raw log loss, AUC (raw scores),
    tier counts, mean / population std of the tiered predictions; best (lowest tiered loss) first.

    Rows are reduced once to sums per interval between consecutive grid values (at most
    3n + 1 intervals x 2 labels); every grid point is then a sum over those few rows. The data
    are never multiplied by the grid."""
    edges = sorted(set(map(float, [*t1, *t2, *t3])))
    pos = F.lit(0)
    for e in edges:
        pos = pos + (F.col(p) >= e).cast("int")
    v0, v1, v2 = values

    def ll(v):
        c = min(max(v, eps), 1 - eps)
        import math

        return -(F.col(y) * math.log(c) + (1 - F.col(y)) * math.log(1 - c))

    raw = log_loss_expr(p, y, eps)
    b = df.groupBy(pos.alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ll(v0)).alias("l0"), F.sum(ll(v1)).alias("l1"), F.sum(ll(v2)).alias("l2"),
        F.sum(raw).alias("lr"), F.sum(F.col(p)).alias("sp"), F.sum(F.col(p) * F.col(p)).alias("sp2"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, bb, c) for a in t1 for bb in t2 for c in t3 if a < bb < c],
                                 "t1 double, t2 double, t3 double")
    # interval k holds p in [edges[k-1], edges[k]); the index of a threshold t is #edges <= t
    idx = {e: i + 1 for i, e in enumerate(edges)}
    gi = grid.select("*", *[F.element_at(F.create_map(*[x for e in edges for x in (F.lit(e), F.lit(idx[e]))]), F.col(c)).alias(f"i{c[1]}")
                            for c in ("t1", "t2", "t3")])
    j = gi.crossJoin(F.broadcast(b))
    k = F.col("_k")
    in0, in1, in2 = k < F.col("i1"), (k >= F.col("i1")) & (k < F.col("i2")), (k >= F.col("i2")) & (k < F.col("i3"))
    in3 = k >= F.col("i3")
    z = F.lit(0.0)
    agg = j.groupBy("t1", "t2", "t3").agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(in0, F.col("l0")).when(in1, F.col("l1")).when(in2, F.col("l2")).otherwise(F.col("lr"))).alias("_tl"),
        F.sum("lr").alias("_rl"),
        F.sum(F.when(in0, F.col("n")).otherwise(0)).alias("tier_0_count"),
        F.sum(F.when(in1, F.col("n")).otherwise(0)).alias("tier_1_count"),
        F.sum(F.when(in2, F.col("n")).otherwise(0)).alias("tier_2_count"),
        F.sum(F.when(in3, F.col("n")).otherwise(0)).alias("tier_3_count"),
        F.sum(F.when(in0, F.col("n") * v0).when(in1, F.col("n") * v1).when(in2, F.col("n") * v2).otherwise(F.col("sp"))).alias("_s1"),
        F.sum(F.when(in0, F.col("n") * v0 * v0).when(in1, F.col("n") * v1 * v1).when(in2, F.col("n") * v2 * v2).otherwise(F.col("sp2"))).alias("_s2"),
    )
    auc = roc_auc(df, p, y).select(F.col("roc_auc").alias("auc"))
    mean = F.col("_s1") / F.col("_n")
    res = agg.crossJoin(F.broadcast(auc)).select(
        "t1", "t2", "t3",
        (F.col("_tl") / F.col("_n")).alias("tiered_logloss"), (F.col("_rl") / F.col("_n")).alias("raw_logloss"), "auc",
        *[F.col(f"tier_{i}_count").cast("long").alias(f"tier_{i}_count") for i in range(4)],
        mean.alias("pred_mean"), F.sqrt(F.greatest(F.col("_s2") / F.col("_n") - mean * mean, z)).alias("pred_std"),
    )
    # one row per grid point, so the sort is bounded by the grid
    return res.orderBy("tiered_logloss", "t1", "t2", "t3").withColumnsRenamed({"t1": "tier1_threshold", "t2": "tier2_threshold", "t3": "tier3_threshold"})


def cv_summary(per_fold: DataFrame, metric: str, group: Sequence[str] = ()) -> DataFrame:
    """Q11: mean and population std of a per-fold metric."""
    return per_fold.groupBy(*_g(group)).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(metric).alias(f"{metric}_mean"),
                                            F.stddev_pop(metric).alias(f"{metric}_std"))


def model_comparison(scores: DataFrame, model: str = "model", p: str = "p", y: str = "y", t: float = 0.5) -> DataFrame:
    """Q12: Brier, log loss, AUC, AP and accuracy per model.

    Two passes: one aggregate for the pointwise metrics, one distinct-score table with a single
    ascending ordered scan; AP's descending counts are totals minus the ascending ones."""
    g = [model]
    point = scores.groupBy(model).agg(
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"),
        F.avg(log_loss_expr(p, y, 1e-15)).alias("log_loss"),
        F.avg(((F.col(p) >= t).cast("int") == F.col(y)).cast("double")).alias("accuracy"))
    tab = _score_table(scores, p, y, None, g)
    s = ordered_scan(tab, g, "_s", [], running={"_cp": F.col("_pos"), "_cn": F.col("_neg")}, bucket_us=_SCORE_BUCKET)
    tot = tab.groupBy(model).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    j = s.join(F.broadcast(tot), model)  # one row per model
    tp = F.col("_P") - F.col("_cp") + F.col("_pos")
    fp = F.col("_N") - F.col("_cn") + F.col("_neg")
    rank = j.groupBy(model).agg(
        F.sum(F.col("_pos") * (F.col("_cn") - F.col("_neg") + 0.5 * F.col("_neg"))).alias("_auc"),
        F.sum(F.col("_pos") * tp / (tp + fp)).alias("_ap"), F.first("_P").alias("_P"), F.first("_N").alias("_N"))
    rank = rank.select(model, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_auc") / (F.col("_P") * F.col("_N"))).alias("roc_auc"),
                       F.when(F.col("_P") > 0, F.col("_ap") / F.col("_P")).alias("average_precision"))
    return point.join(rank, g).select(model, "brier", "log_loss", "roc_auc", "average_precision", "accuracy")


def mse(df: DataFrame, pred: str, actual: str, group: Sequence[str] = ()) -> DataFrame:
    """Q13: mean squared error."""
    return df.groupBy(*_g(group)).agg(F.avg((F.col(pred) - F.col(actual)) ** 2).alias("mse"))
