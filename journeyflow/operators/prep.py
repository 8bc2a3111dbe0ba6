"""Scaling, encoding and feature selection (inventory M5-M8, M10, M11).

Fitted statistics are one-row aggregates joined back as a broadcast (a single row: bounded).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str], population: bool = True, floor: float | None = None) -> DataFrame:
    """M5/M6: one row with ``<c>_mean`` and ``<c>_std`` (population std by default, like a numpy /
    scikit-learn scaler; ``floor``: std below it becomes 1)."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in cols:
        s = sd(F.col(c).cast("double"))
        if floor is not None:
            s = F.when(s < floor, F.lit(1.0)).otherwise(s)
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), s.alias(f"{c}_std")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """M5/M6: z-score with fitted statistics (fitted on train, applied to every split).
    A zero std (constant column) gives 0 instead of a division by zero."""
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in cols:
            sd = F.col(f"{c}_std")
            z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c).cast("double") - F.col(f"{c}_mean")) / sd)
            out.append(z.alias(f"{c}{suffix}"))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def one_hot(df: DataFrame, cols: Sequence[str], values: dict, drop_prefixes: Sequence[str] = (),
            keep_original: bool = False) -> DataFrame:
    """M7: one 0/1 INT column per category value (``<col>_<value>``; NULL -> ``<col>_nan``).
    ``values`` lists the categories of each column: they name the output columns, so they are an
    argument and not looked up in the data.
    Dummies whose name starts with one of ``drop_prefixes`` (leaking categories) are dropped."""
    exprs = [F.col(c) for c in df.columns if keep_original or c not in cols]
    for c in cols:
        for v in values[c]:
            name = f"{c}_nan" if v is None else f"{c}_{v}"
            if any(name.startswith(p) for p in drop_prefixes):
                continue
            cond = F.col(c).isNull() if v is None else (F.col(c) == F.lit(v))
            exprs.append(F.coalesce(cond, F.lit(False)).cast("int").alias(name))
    return df.select(*exprs)


def index_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M8: stable integer code per category (dense rank of the sorted distinct values, NULL -> 0).

    The code table holds one row per distinct value; it is ranked in balanced ranges and joined
    back (adaptive execution broadcasts it by measured bytes)."""
    from journeyflow.operators.sampling import rank_distinct

    out = df
    for c in cols:
        values = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = rank_distinct(values, c, f"{c}_code").select(c, F.col(f"{c}_code").cast("int").alias(f"{c}_code"))
        out = out.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0)))
    return out


def select_by_importance(imp: DataFrame, factor: float = 1.25, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Features whose importance exceeds ``factor`` x the mean importance."""
    m = imp.agg(F.avg(importance).alias("_m"))
    return imp.crossJoin(F.broadcast(m)).where(F.col(importance) > F.lit(factor) * F.col("_m")).drop("_m")


def select_by_threshold(imp: DataFrame, threshold: float, importance: str = "importance") -> DataFrame:
    """Features whose importance (or mean |Shapley|) is above a fixed threshold."""
    return imp.where(F.col(importance) > threshold)
