"""Sampling and splitting (inventory N1-N10).

Randomness is a stable hash of (row key, seed) -- ``hash_uniform`` -- so a sample does not
depend on partitioning or task retries. Exact counts use a rank inside each class computed
with the two-level ordered scan (class, hash bucket), so even a class holding most rows is
ranked by many tasks; per-class totals are a tiny aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.functions.scalar import hash_uniform
from journeyflow.operators.ordered import BOUNDS, ordered_scan, with_position

_U_SCALE = 4294967296  # 2^32: hash_uniform is k / 2^32 exactly
_U_BUCKET = _U_SCALE // 4096


def _u_long(key: str, seed: int) -> Column:
    return F.floor(hash_uniform(F.col(key), seed) * F.lit(float(_U_SCALE))).cast("long")


def rank_by_hash(df: DataFrame, key: str, seed: int, strata: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its stratum, in hash order (ties by key)."""
    d = df.withColumn("_u", _u_long(key, seed))
    if not strata:
        d = d.withColumn("_all", F.lit(0))
        strata = ["_all"]
    r = ordered_scan(d, list(strata), "_u", [key], index=name, bucket_us=_U_BUCKET)
    return r.drop("_u", "_all") if "_all" in r.columns else r.drop("_u")


def _class_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Keep rows whose hash uniform is below ``fraction`` (Bernoulli, layout independent)."""
    return df.where(hash_uniform(F.col(key), seed) < fraction)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``n`` rows (all when fewer): the n smallest hash values (top-n per task, merged)."""
    return df.withColumn("_u", hash_uniform(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def stratified_split(df: DataFrame, label: str = "y", test: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds ``split`` ('train' / 'valid'); each class gets ceil(test * class size) valid rows."""
    r = rank_by_hash(df, key, seed, [label], "_r").join(_class_sizes(df, [label]), label)
    valid = F.col("_r") <= F.ceil(F.col("_n") * test)
    return r.withColumn("split", F.when(valid, "valid").otherwise("train")).drop("_r", "_n")


def split(df: DataFrame, test: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Plain split, ceil(test * n) valid rows; other columns (weights) are carried along."""
    r = rank_by_hash(df, key, seed, [], "_r")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = r.crossJoin(F.broadcast(n))
    return r.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * test), "valid").otherwise("train")).drop("_r", "_n")


def _in_ranges(values: DataFrame, key: str, bounds: int) -> tuple[DataFrame, DataFrame]:
    """``values`` (distinct values of ``key``) with ``_range``, a number that grows with the value, and
    the one-row frame of ``_bounds``, the sorted values that cut the ranges.

    The bounds are the ``bounds`` values of least hash, so the ranges are balanced however the
    values are spelled; a value's range is the number of bounds up to it, found by binary search.
    NULL is in range 0."""
    chosen = values.select(key).orderBy(F.xxhash64(key), key).limit(bounds)
    cuts = chosen.agg(F.sort_array(F.collect_list(key)).alias("_bounds"))  # one row, without NULL
    return with_position(values.crossJoin(F.broadcast(cuts)), "_bounds", F.col(key), bounds, "_range"), cuts


def rank_distinct(values: DataFrame, key: str, name: str, bounds: int = BOUNDS) -> DataFrame:
    """1-based rank of each row of ``values`` (distinct values of ``key``) in sorted order, ranked
    inside balanced ranges with the ranges' counts carried over."""
    d, _ = _in_ranges(values, key, bounds)
    r = ordered_scan(d.withColumn("_all", F.lit(0)), ["_all"], key, index=name, bucket_col="_range")
    return r.drop("_all", "_range")


def kth_distinct(values: DataFrame, key: str, k: Callable[[Column], Column], name: str, bounds: int = BOUNDS) -> DataFrame:
    """One row: the k-th smallest of ``values`` (distinct values of ``key``), ``k`` being computed from
    their number. NULL counts as a value and comes last; beyond the others the greatest of them is
    given, for k < 1 or without any value NULL.

    The values are counted by balanced range; only the range that holds the k-th is sorted."""
    d, cuts = _in_ranges(values, key, bounds)
    sizes = d.groupBy("_range").agg(F.count(key).alias("_n"), F.count(F.lit(1)).alias("_rows")).withColumn("_all", F.lit(0))
    w = Window.partitionBy("_all")  # over at most ``bounds`` + 1 rows
    upto = F.sum("_n").over(w.orderBy("_range"))
    kth = F.least(k(F.sum("_rows").over(w)), F.sum("_n").over(w))
    at = sizes.select("_range", (kth - (upto - F.col("_n"))).alias("_at"), "_n").where(F.col("_at").between(F.lit(1), F.col("_n")))
    at = at.crossJoin(F.broadcast(cuts)).select(
        "_at", F.get("_bounds", F.col("_range") - 1).alias("_low"), F.get("_bounds", F.col("_range")).alias("_high"))  # one row, or none
    v = F.col(key)
    own = (F.col("_low").isNull() | (v >= F.col("_low"))) & (F.col("_high").isNull() | (v < F.col("_high"))) & v.isNotNull()
    own = values.select(key).join(F.broadcast(at), own).withColumn("_r", F.row_number().over(Window.partitionBy("_at").orderBy(key)))
    return own.where(F.col("_r") == F.col("_at")).agg(F.max(key).alias(name))


def id_split(df: DataFrame, train: float = 0.8, key: str = "id") -> DataFrame:
    """The first ``floor(train * n_ids)`` ids in sorted order are 'train', the rest 'valid';
    every row of an id lands on the same side. Rows without an id are left out, NULL still counts
    as the last id. An id's rank is within the limit if it is at most the id at the limit, so one
    id is looked for and the rows are compared with it where they are, without a shuffle."""
    last = kth_distinct(df.select(key).distinct(), key, lambda n: F.floor(n * train), "_last")
    rows = df.where(F.col(key).isNotNull()).crossJoin(F.broadcast(last))
    split = F.when(F.col(key) <= F.col("_last"), "train").otherwise("valid").alias("split")
    return rows.select(key, *[c for c in df.columns if c != key], split)


def stratified_folds(df: DataFrame, label: str = "y", k: int = 5, seed: int = 42, key: str = "id") -> DataFrame:
    """Fold 0..k-1 = (rank in class by hash - 1) mod k: class shares equal in every fold."""
    r = rank_by_hash(df, key, seed, [label], "_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def resample_to_rate(df: DataFrame, label: str = "y", rate: float = 0.05, seed: int = 42, key: str = "id") -> DataFrame:
    """Keep all negatives and min(n_pos, max(1, floor(n_neg * rate / (1 - rate)))) positives."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("_np"), F.count_if(F.col(label) == 0).alias("_nn"))
    target = F.least(F.col("_np"), F.greatest(F.lit(1), F.floor(F.col("_nn") * rate / (1.0 - rate)))).alias("_t")
    pos = rank_by_hash(df.where(F.col(label) == 1), key, seed, [], "_r").crossJoin(F.broadcast(sizes.select(target)))
    pos = pos.where(F.col("_r") <= F.col("_t")).drop("_r", "_t")
    return pos.unionByName(df.where(F.col(label) == 0))


def _quota_sample(df: DataFrame, quotas: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    r = rank_by_hash(df, key, seed, [label], "_r").join(quotas, label)
    return r.where(F.col("_r") <= F.col("_q")).drop("_r", "_q")


def stratified_cap(df: DataFrame, n: int, label: str = "y", seed: int = 42, key: str = "id") -> DataFrame:
    """At most ``n`` rows with the class shares kept (quota = floor(n * share), rest to the
    largest class so the total is exactly n); unchanged when the table has <= n rows."""
    sizes = _class_sizes(df, [label])
    tot = sizes.agg(F.sum("_n").alias("_tot"), F.max(F.struct("_n", label)).alias("_big"))
    q = sizes.crossJoin(F.broadcast(tot)).select(
        label,
        F.when(F.col("_tot") <= n, F.col("_n")).otherwise(F.floor(F.lit(n) * F.col("_n") / F.col("_tot"))).alias("_q0"),
        "_tot", F.col("_big")[label].alias("_bl"))
    fix = q.agg(F.sum("_q0").alias("_s"))
    q = q.crossJoin(F.broadcast(fix)).select(
        label, (F.col("_q0") + F.when((F.col(label) == F.col("_bl")) & (F.col("_tot") > n), F.lit(n) - F.col("_s")).otherwise(0)).alias("_q"))
    return _quota_sample(df, q, label, seed, key)


def balanced_validation(df: DataFrame, n: int, pos_rate: float = 0.05, label: str = "y", seed: int = 42, key: str = "id") -> DataFrame:
    """Fixed-size set with int(n * pos_rate) positives and the rest negatives (capped by what
    is available)."""
    n_pos = int(n * pos_rate)
    sizes = _class_sizes(df, [label])
    q = sizes.select(label, F.least(F.col("_n"), F.when(F.col(label) == 1, F.lit(n_pos)).otherwise(F.lit(n - n_pos))).alias("_q"))
    return _quota_sample(df, q, label, seed, key)


def subsample_split(df: DataFrame, stored_split: DataFrame, n: int, pos_rate: float = 0.05, label: str = "y", seed: int = 42, key: str = "id") -> DataFrame:
    """Rows of a stored split (semi join on the key); if it holds more than n rows, the
    N9 subsample of it."""
    kept = df.join(stored_split.select(key), key, "left_semi")
    total = kept.agg(F.count(F.lit(1)).alias("_t"))
    bal = balanced_validation(kept, n, pos_rate, label, seed, key)
    small = kept.crossJoin(F.broadcast(total)).where(F.col("_t") <= n).drop("_t")
    big = bal.crossJoin(F.broadcast(total)).where(F.col("_t") > n).drop("_t")
    return small.unionByName(big)
