"""Model explanation (inventory R3-R7, plus I10 interpolation and I12 grids).

A scorer is any ``Callable[[DataFrame], DataFrame]`` that adds a probability column ``p``
(a fixed-coefficient logit, a fitted Spark ML model wrapped by ``ml_scorer``...). Profile
grids are small and their size is a parameter, so every cross join here is
``rows x grid`` with both sides bounded by arguments, never by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.functions.arrays import count_upto
from journeyflow.functions.scalar import linspace
from journeyflow.operators.sampling import sample_n

Scorer = Callable[[DataFrame], DataFrame]


def logit_scorer(intercept: float, weights: Mapping[str, float], out: str = "p", digits: int | None = 6) -> Scorer:
    """Fixed-coefficient logistic scorer: p = sigmoid(b0 + sum w_i x_i)."""
    def score(df: DataFrame) -> DataFrame:
        z = F.lit(float(intercept))
        for c, w in weights.items():
            z = z + F.lit(float(w)) * F.col(c).cast("double")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return df.withColumn(out, F.round(p, digits) if digits is not None else p)

    return score


def linspace_grid(df: DataFrame, feature: str, n: int, lo_q: float | None, hi_q: float | None,
                  include: Column | None = None) -> DataFrame:
    """``n`` evenly spaced values between two quantiles (or min / max) of ``feature``,
    sorted and de-duplicated, optionally with an extra value inserted. Returns (grid_value)."""
    from journeyflow.operators.quantiles import exact_percentiles

    qs = [(q, n) for q, n in ((lo_q, "_lo"), (hi_q, "_hi")) if q is not None]
    mm = df.agg(F.min(feature).cast("double").alias("_mn"), F.max(feature).cast("double").alias("_mx"))
    if qs:
        mm = mm.crossJoin(exact_percentiles(df, feature, [q for q, _ in qs], [n for _, n in qs]))
    ends = mm.select(F.col("_lo") if lo_q is not None else F.col("_mn").alias("_lo"),
                     F.col("_hi") if hi_q is not None else F.col("_mx").alias("_hi"))
    arr = linspace("_lo", "_hi", n)
    g = ends.select(F.explode(arr).alias("grid_value"))
    if include is not None:
        g = g.unionByName(df.sparkSession.range(1).select(include.cast("double").alias("grid_value")))
    return g.distinct()


def pdp_ice(df: DataFrame, scorer: Scorer, feature: str, grid_n: int = 30, n_rows: int = 100, seed: int = 42,
            key: str = "id", lo_q: float = 0.05, hi_q: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """ICE curves for ``n_rows`` hashed-sample rows and the PDP mean over all rows, over a grid
    spanning the [lo_q, hi_q] quantiles of the feature. Returns (ice, pdp). The grid (``grid_n``
    values) is exploded in the map and averaged by partial aggregation."""
    grid = linspace_grid(df, feature, grid_n, lo_q, hi_q)

    def curves(rows: DataFrame) -> DataFrame:
        s = scorer(rows.crossJoin(F.broadcast(grid)).withColumn(feature, F.col("grid_value")))
        return s.select(key, "grid_value", "p")

    ice = curves(sample_n(df, n_rows, seed, key))
    pdp = curves(df).groupBy("grid_value").agg(F.avg("p").alias("pdp"), F.count(F.lit(1)).alias("n_rows"))
    return ice, pdp


def cp_numeric(df: DataFrame, scorer: Scorer, row: DataFrame, feature: str, n: int = 60,
               lo_q: float | None = 0.02, hi_q: float | None = 0.98, profile: str = "profile", key: str = "id") -> DataFrame:
    """Ceteris-paribus curve of one row: the feature swept over a grid (quantiles of the
    whole table, plus the row's own value), everything else fixed."""
    ref = row.select(F.col(feature).cast("double").alias("_ref"))
    grid = linspace_grid(df, feature, n, lo_q, hi_q).unionByName(ref.select(F.col("_ref").alias("grid_value"))).distinct()
    prof = row.crossJoin(F.broadcast(grid)).withColumn("reference_value", F.col(feature).cast("double")).withColumn(feature, F.col("grid_value"))
    s = scorer(prof)
    return s.select(F.lit(profile).alias("profile_name"), F.col(key), F.lit(feature).alias("feature"),
                    F.col("grid_value").alias("feature_value"), F.col("p").alias("predicted_success_probability"), "reference_value")


def cp_categorical(row: DataFrame, scorer: Scorer, dummies: Sequence[str], profile: str = "profile", key: str = "id") -> DataFrame:
    """For one row, zero every dummy of a categorical group, set one at a time, score, rank."""
    cats = row.sparkSession.createDataFrame([(d,) for d in dummies], "category string")
    j = row.crossJoin(F.broadcast(cats))
    for d in dummies:
        j = j.withColumn(d, F.when(F.col("category") == d, F.lit(1)).otherwise(F.lit(0)))
    s = scorer(j)
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("p").desc(), F.col("category"))  # one row x few categories
    return s.select(F.lit(profile).alias("profile_name"), key, "category", F.col("p").alias("predicted_success_probability"),
                    F.rank().over(w).alias("rank"))


def shapley_linear(df: DataFrame, intercept: float, weights: Mapping[str, float], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """R6 (exact, linear margin): phi_i(x) = w_i (x_i - mean x_i). Returns (per-row values in
    long form, ranking by mean |phi|). For each row sum_i phi_i = z(x) - z(mean x)."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in weights])
    j = df.crossJoin(F.broadcast(means))
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.col(f"_m_{c}"))).alias("phi")) for c, w in weights.items()])
    long = j.select(key, F.explode(arr).alias("s")).select(key, "s.feature", "s.phi")
    rank = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    return long, rank


def shapley_permutation(rows: DataFrame, background: DataFrame, scorer: Scorer, features: Sequence[str],
                        n_perm: int = 8, seed: int = 42, key: str = "id") -> DataFrame:
    """R6 (any scorer, sampled): permutation Shapley estimate against a one-row background
    (feature means). For each row and each of ``n_perm`` hashed permutations, features are
    switched from the background to the row's value in permutation order; the score change at
    each switch is that feature's contribution. Work = rows x n_perm x (features + 1) scores,
    exploded in the map; a score counts for the feature switched last and against the one switched
    next, so one sum per row and feature is all that is shuffled. Returns (key, feature, phi)."""
    k = len(features)
    bg = background.agg(*[F.avg(F.col(c).cast("double")).alias(f"_b_{c}") for c in features])
    # position of each feature in permutation _perm: rank of a hash of (perm, feature)
    order = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_perm").cast("string"), F.lit(f"|{c}"))), 1, 8), 16, 10).cast("long")
             for c in features]
    pos = []
    for i, oi in enumerate(order):
        r = F.lit(0)
        for j, oj in enumerate(order):
            if j != i:
                r = r + ((oj < oi) | ((oj == oi) & F.lit(j < i))).cast("int")
        pos.append(r)
    perms = rows.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("_perm")).select("_perm", *[p.alias(f"_pos_{c}") for p, c in zip(pos, features)])
    steps = rows.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("_step"))
    grid = perms.crossJoin(steps)  # n_perm x (k + 1) rows
    base = rows.select(key, *features).crossJoin(F.broadcast(bg)).crossJoin(F.broadcast(grid))
    mixed = base.select(key, "_step", *[f"_pos_{c}" for c in features],
                        *[F.when(F.col(f"_pos_{c}") < F.col("_step"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c) for c in features])
    scored = scorer(mixed)
    sums = [F.sum(F.when(F.col(f"_pos_{c}") == F.col("_step") - 1, F.col("p")).when(F.col(f"_pos_{c}") == F.col("_step"), -F.col("p"))).alias(f"_phi_{c}")
            for c in features]
    phi = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"_phi_{c}") / n_perm).alias("phi")) for c in features])).alias("s")
    return scored.groupBy(key).agg(*sums).select(key, phi).select(key, "s.feature", "s.phi")


def interpolate(curve: DataFrame, points: DataFrame, key: str, x: str = "feature_value", y: str = "predicted_success_probability",
                at: str = "x") -> DataFrame:
    """Y of each query point on a piecewise-linear curve (per key); ends are clamped.

    A key's curve is one sorted array (a profile grid), and a point finds its place in it by
    binary search in an expression: points are neither multiplied by the grid nor grouped."""
    at_x = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    curves = curve.where(F.col(x).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(at_x)).alias("_c"))
    j = points.select(key, F.col(at).alias("_x")).join(curves, key)
    n = F.size("_c")
    pos = count_upto(F.transform("_c", lambda c: c["x"]), F.col("_x"), 1 << 20)
    j = j.withColumn("_pos", pos).withColumn("_lo", F.get("_c", F.greatest(F.col("_pos"), F.lit(1)) - 1)).withColumn("_hi", F.get("_c", F.least(F.col("_pos"), n - 1)))
    lo, hi = F.col("_lo"), F.col("_hi")
    val = F.when((F.col("_pos") == 0) | (F.col("_pos") == n) | (lo["x"] == F.col("_x")), lo["y"]).otherwise(
        lo["y"] + (F.col("_x") - lo["x"]) * (hi["y"] - lo["y"]) / (hi["x"] - lo["x"]))
    return j.select(key, F.col("_x").alias(at), val.alias("interpolated"))


def observation_report(df: DataFrame, row_key, features: Sequence[str], curve: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The chosen row's raw feature values in long form (feature, value), with the profile's
    probability at the row's own value when a curve is given."""
    r = df.where(F.col(key) == F.lit(row_key)) if not isinstance(row_key, DataFrame) else df.join(row_key.select(key), key, "left_semi")
    long = r.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("s")).select(key, "s.*")
    if curve is not None:
        pt = curve.where(F.col("feature_value") == F.col("reference_value")).select(
            key, "feature", F.col("predicted_success_probability").alias("p_at_value"))
        long = long.join(pt, [key, "feature"], "left")
    return long
