"""Skew-safe ordered scans over events of one key (previous row, running sums, step index).

A plain ``Window.partitionBy(id)`` sends every event of an id to one task, so one hot
id (say a third of all rows) would serialise the job. Here the order is split in two
levels instead:

1. events are windowed inside ``(key, bucket)``. An id with few rows is one bucket; an id with a
   third of all rows is cut at some `BOUNDS` / 3 of its own rows, those of least hash, so its
   buckets hold about the same number of rows wherever they lie in time, even inside one hour
   (rows of one moment stay together);
2. a per-bucket summary (last row, bucket sums) is windowed per key. It holds at most one
   row per bucket, so a key has at most `BOUNDS` + 1 of them;
3. the summary is joined back on ``(key, bucket)`` to carry values across bucket edges.

The cuts take one more narrow pass over the key and order columns, of which every task keeps the
`BOUNDS` least hashes; they are a broadcast table of `BOUNDS` places at most. Where rows are already known to be spread evenly
(ranks of hashes, distinct scores) callers give a fixed bucket width instead.

The result equals the single-window answer for the total order ``(ts_us, *tie)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.functions.arrays import count_upto

BOUNDS = 1023
_NULL_BUCKET = -(1 << 62)  # rows whose order value is NULL sort first, like NULLS FIRST


def with_position(df: DataFrame, array: str, x: Column, most: int, name: str) -> DataFrame:
    """``df`` with ``name`` in place of ``array``, a sorted array of ``most`` elements at most (or
    NULL): how many of its elements are at most ``x``."""
    found = F.when(F.col(array).isNull(), F.lit(0)).otherwise(count_upto(array, x, most))
    return df.withColumn(name, found).drop(array)


def key_cuts(df: DataFrame, keys: Sequence[str], order: str, bounds: int = BOUNDS) -> DataFrame:
    """Rows (_ck0.., _cuts): the sorted order values at which keys with many rows are cut.

    Of the ``bounds`` rows of least hash, those of keys that hold two or more: ``bounds`` values
    in all, at most, so the table may be broadcast."""
    own = [f"_ck{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(c) for k, c in zip(keys, own, strict=True)], F.col(order).alias("_at"))
    sample = rows.orderBy(F.xxhash64(*own, "_at"), *own, "_at").limit(bounds)
    return sample.groupBy(*own).agg(F.sort_array(F.collect_set("_at")).alias("_cuts")).where(F.size("_cuts") > 1)


def _with_bucket(df: DataFrame, keys: Sequence[str], order: str, bucket_us, bucket_col: str | None = None, bounds: int = BOUNDS) -> DataFrame:
    """``df`` with ``_bkt``, a bucket number that grows with the order inside a key; equal order values share a bucket."""
    if bucket_col or bucket_us:
        b = F.col(bucket_col).cast("long") if bucket_col else F.floor(F.col(order) / F.lit(bucket_us))
        return df.withColumn("_bkt", F.coalesce(b, F.lit(_NULL_BUCKET).cast("long")))
    cuts = key_cuts(df, keys, order, bounds)
    on = [F.col(k).eqNullSafe(F.col(f"_ck{i}")) for i, k in enumerate(keys)]
    d = df.join(F.broadcast(cuts), on, "left").drop(*[f"_ck{i}" for i in range(len(keys))])
    return with_position(d, "_cuts", F.col(order), bounds, "_bkt")


def _join_back(d: DataFrame, summ: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the per-bucket carry to the rows; NULL keys match NULL keys (null-safe), so no
    row is lost."""
    ren = {k: f"_sk{i}" for i, k in enumerate(keys)}
    s = summ.select(*[F.col(k).alias(v) for k, v in ren.items()], F.col("_bkt").alias("_sb"),
                    *[c for c in summ.columns if c not in ren and c != "_bkt"])
    cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in ren.items()] + [F.col("_bkt") == F.col("_sb")]
    return d.join(s, cond, "inner").drop(*ren.values(), "_sb")


def ordered_scan(
    df: DataFrame,
    key: str | Sequence[str],
    order_us: str,
    tie: Sequence[str] = (),
    *,
    prev: Sequence[str] = (),
    running: Mapping[str, Column] | None = None,
    index: str | None = None,
    bucket_us: int | None = None,
    key_bounds: bool = False,
    key_totals: bool = False,
    bucket_col: str | None = None,
    bounds: int = BOUNDS,
) -> DataFrame:
    """Add ``prev_<c>`` for each column in ``prev`` (value on the previous row of the key,
    NULL on the first), one inclusive running sum per ``running`` entry, and optionally a
    1-based step number ``index``; order is ``(order_us, *tie)`` inside each key.
    ``key_bounds`` also adds ``key_first`` / ``key_last`` (min / max of ``order_us`` over the
    key), taken from the per-bucket summary at no extra shuffle; ``key_totals`` adds
    ``<name>_total`` (the key's total of each running sum) the same way. ``bucket_col`` replaces
    the balanced buckets by a given bucket number that must grow with ``order_us``, ``bucket_us``
    by buckets of a fixed width."""
    keys = [key] if isinstance(key, str) else list(key)
    running = dict(running or {})
    if index:
        running[index] = F.lit(1)
    order = [order_us, *tie]

    d = _with_bucket(df, keys, order_us, bucket_us, bucket_col, bounds)
    w1 = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    w1c = w1.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.lag(c).over(w1).alias(f"_lp_{c}") for c in prev]
    local += [F.sum(e).over(w1c).alias(f"_lc_{n}") for n, e in running.items()]
    d = d.select("*", *local)

    # one row per (key, bucket): its last row in the order, and bucket totals
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[F.col(c).alias(f"p_{c}") for c in prev])) if prev else None
    aggs = ([last.alias("_last")] if prev else []) + [F.sum(e).alias(f"_bs_{n}") for n, e in running.items()]
    if key_bounds:
        aggs += [F.min(order_us).alias("_bmin"), F.max(order_us).alias("_bmax")]
    # computed from the windowed frame: it is already clustered by (key, bucket), so no new shuffle
    summ = d.groupBy(*keys, "_bkt").agg(*aggs)
    w2 = Window.partitionBy(*keys).orderBy("_bkt")
    carry = [F.lag("_last").over(w2).alias("_plast")] if prev else []
    carry += [
        F.sum(f"_bs_{n}").over(w2.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_off_{n}")
        for n in running
    ]
    wk = Window.partitionBy(*keys)  # over the key's bucket rows: bounded
    if key_bounds:
        carry += [F.min("_bmin").over(wk).alias("key_first"), F.max("_bmax").over(wk).alias("key_last")]
    if key_totals:
        carry += [F.sum(f"_bs_{n}").over(wk).alias(f"{n}_total") for n in running]
    summ = summ.select(*keys, "_bkt", *carry)

    out = _join_back(d, summ, keys)
    cols = [F.coalesce(F.col(f"_lp_{c}"), F.col("_plast")[f"p_{c}"]).alias(f"prev_{c}") for c in prev]
    cols += [(F.col(f"_lc_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in running]
    if key_bounds:
        cols += [F.col("key_first"), F.col("key_last")]
    if key_totals:
        cols += [F.col(f"{n}_total") for n in running]
    drop = {"_bkt", "_plast", *[f"_lp_{c}" for c in prev], *[f"_lc_{n}" for n in running], *[f"_off_{n}" for n in running]}
    keep = [c for c in d.columns if c not in drop and c not in running]
    return out.select(*keep, *cols)


def running_flag_groups(
    df: DataFrame,
    key: str | Sequence[str],
    order_us: str,
    tie: Sequence[str],
    flag: Column,
    name: str,
    bucket_us: int | None = None,
) -> DataFrame:
    """Running count of ``flag`` (a 0/1 Column) per key: a group number that starts a new
    group wherever the flag is 1 (sessionisation)."""
    return ordered_scan(df, key, order_us, tie, running={name: flag.cast("long")}, bucket_us=bucket_us)


def session_numbers(
    df: DataFrame,
    key: str | Sequence[str],
    order_us: str,
    tie: Sequence[str],
    gap_us: int,
    name: str = "session",
    bucket_us: int | None = None,
) -> DataFrame:
    """1-based session number per key: a new session starts at the first event and after every
    gap strictly above ``gap_us``. One fused two-level scan (no chained scans):

    * rows, windowed inside (key, bucket): starts inside the bucket, running;
    * per bucket: first / last time and the count of inside starts;
    * per key over its buckets: the boundary start of each bucket (its first event vs the
      previous bucket's last) and the running total of starts before the bucket.
    """
    keys = [key] if isinstance(key, str) else list(key)
    t = F.col(order_us)

    def inside(frame: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "_bkt").orderBy(order_us, *tie)
        lag = F.lag(order_us).over(w)
        flag = F.when(lag.isNull(), F.lit(0)).otherwise(((t - lag) > gap_us).cast("int"))
        return frame.withColumn("_in", flag).withColumn(
            "_in_cum", F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    d = inside(_with_bucket(df, keys, order_us, bucket_us))
    summ = d.groupBy(*keys, "_bkt").agg(F.min(order_us).alias("_f"), F.max(order_us).alias("_l"), F.sum("_in").alias("_n_in"))
    w2 = Window.partitionBy(*keys).orderBy("_bkt")
    prev_last = F.lag("_l").over(w2)
    boundary = F.when(prev_last.isNull(), F.lit(1)).otherwise(((F.col("_f") - prev_last) > gap_us).cast("int"))
    summ = summ.select(*keys, "_bkt", boundary.alias("_bd"), "_n_in")
    summ = summ.select(*keys, "_bkt", "_bd", F.coalesce(
        F.sum(F.col("_bd") + F.col("_n_in")).over(w2.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = _join_back(d, summ, keys)
    return out.withColumn(name, (F.col("_off") + F.col("_bd") + F.col("_in_cum")).cast("long")).drop(
        "_bkt", "_in", "_in_cum", "_bd", "_off")
