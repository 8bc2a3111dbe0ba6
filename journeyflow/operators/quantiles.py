"""Exact order statistics over a counted-value table.

``percentile`` keeps every distinct value in one buffer, and a window over raw rows sends equal
values to one task. Here columns are unpivoted and counted first: one row per (group, column,
distinct value) with its weight, a partial aggregate, so a value that half the rows share is one
row. The rest works on that table:

1. 1023 of its values, those of least hash, bound balanced ranges of values (a one-row broadcast);
2. range weights, summed per (group, column) over at most 1024 ranges, tell which range holds
   each wanted rank and how much weight stands before it;
3. only those ranges are ranked, each by its own task, to find the values at the wanted ranks.

Nothing runs while the plan is built. ``linear`` interpolates like SQL ``quantile_cont`` /
``median``: at position p (n - 1), lo + frac (hi - lo); ``disc`` returns the first value whose
cumulative share reaches p. NULL and NaN values are ignored; NULL group values form a group.
Without rows, a grouped result is empty and one without groups is a row of NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.operators.ordered import BOUNDS, with_position


def percentile_names(ps: Sequence[float]) -> list[str]:
    return [f"p{int(round(p * 100))}" for p in ps]


def value_counts(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows (group, column_name, _x, _n): how often each value of each column stands in each group."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in cols]
    long = df.select(*group, (F.explode(F.array(*pairs)) if len(pairs) > 1 else pairs[0]).alias("_kv")).select(*group, "_kv.*")
    return long.where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*group, "column_name", "_x").agg(F.count(F.lit(1)).alias("_n"))


def _ranks(total: Column, p: float, method: str) -> tuple[Column, Column]:
    """The two ranks (from 1) whose values a percentile lies between."""
    if method == "linear":
        at = F.lit(float(p)) * (total - 1).cast("double")
        return F.floor(at).cast("long") + 1, F.least(F.ceil(at).cast("long") + 1, total)
    k = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * total).cast("long"))
    return k, k


def counted_percentiles(counted: DataFrame, keys: Sequence[str], ps: Sequence[float], names: Sequence[str], method: str = "linear",
                        bounds: int = BOUNDS) -> DataFrame:
    """Percentiles per ``keys`` of a table with distinct values ``_x`` and weights ``_n``."""
    keys = list(keys)
    chosen = counted.select("_x", F.xxhash64(*keys, "_x").alias("_h")).orderBy("_h", "_x").limit(bounds)
    edges = chosen.agg(F.sort_array(F.collect_list("_x")).alias("_bounds"))
    dealt = with_position(counted.crossJoin(F.broadcast(edges)), "_bounds", F.col("_x"), bounds, "_range")  # one row

    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
    own = Window.partitionBy(*keys)  # a row per range
    before = F.coalesce(F.sum("_rn").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = sums.withColumns({"_before": before, "_total": F.sum("_rn").over(own)})
    wanted = [_ranks(F.col("_total"), p, method) for p in ps]
    holds = [(F.col("_before") < r) & (r <= F.col("_before") + F.col("_rn")) for lo, hi in wanted for r in (lo, hi)]
    runs = runs.where(reduce(lambda a, b: a | b, holds))

    there = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_kr"), "_before", "_total")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_range") == F.col("_kr")]
    inside = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(there, on).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto")), F.col("_x")))

    found = [(value_at(lo).alias(f"_lo_{n}"), value_at(hi).alias(f"_hi_{n}")) for (lo, hi), n in zip(wanted, names, strict=True)]
    got = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *[c for pair in found for c in pair])
    out = []
    for p, n in zip(ps, names, strict=True):
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        at = F.lit(float(p)) * (F.col("_total") - 1).cast("double")
        out.append((lo + (at - F.floor(at)) * (hi - lo) if method == "linear" else lo).alias(n))
    return got.select(*keys, *out)


def column_percentiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], names: Sequence[str] | None = None,
                       group: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Rows (group, column_name, one column per percentile) for several columns in one pass."""
    return counted_percentiles(value_counts(df, cols, group), [*group, "column_name"], ps, list(names or percentile_names(ps)), method)


def exact_percentiles(df: DataFrame, col: str, ps: Sequence[float], names: Sequence[str] | None = None,
                      group: Sequence[str] = (), method: str = "linear", bounds: int = BOUNDS) -> DataFrame:
    """One row per group with one column per requested percentile."""
    names = list(names or percentile_names(ps))
    found = counted_percentiles(value_counts(df, [col], group), [*group, "column_name"], ps, names, method, bounds)
    return found.drop("column_name") if group else found.agg(*[F.max(n).alias(n) for n in names])  # one row


def exact_median(df: DataFrame, col: str, name: str = "median", group: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, col, [0.5], [name], group)


def medians(df: DataFrame, named: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """One row per group with the median of each column, named as ``named`` says, in one pass."""
    found = column_percentiles(df, list(named), [0.5], ["_m"], group)
    wide = [F.max(F.when(F.col("column_name") == c, F.col("_m"))).alias(n) for c, n in named.items()]
    return found.groupBy(*group).agg(*wide) if group else found.agg(*wide)
