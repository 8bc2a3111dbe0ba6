"""Sequence tensors (inventory M1-M4, M9).

Arrays are built only after each journey has been cut to its bounded window (last or first
n steps): the window is chosen on flat rows with the skew-safe step index, then at most n
elements per id are collected and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.functions.arrays import pad, pad_mask
from journeyflow.operators.features import step_inputs
from journeyflow.operators.ordered import ordered_scan
from journeyflow.schema import DEFAULT_COLS, JourneyCols


def _window_steps(df: DataFrame, n: int, keep: str, cols: JourneyCols) -> DataFrame:
    s = step_inputs(df, cols, index="_step")
    if keep == "last":
        s = s.where(F.col("_step") > F.col("_step_total") - n)
    else:
        s = s.where(F.col("_step") <= n)
    return s.drop("_step_total")


def _collect(s: DataFrame, fields: dict[str, Column], cols: JourneyCols) -> DataFrame:
    g = s.groupBy(cols.id).agg(F.array_sort(F.collect_list(F.struct(F.col("_step"), *[e.alias(k) for k, e in fields.items()]))).alias("_a"))
    return g.select(cols.id, *[F.transform("_a", _field(k)).alias(k) for k in fields])


def _field(k: str):
    return lambda x: x[k]


def pad_sequences(df: DataFrame, n: int = 128, keep: str = "last", side: str = "right", log_deltas: bool = True,
                  mask_pad_true: bool = False, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """M1-M3: per id the kept steps (``keep`` last or first n) as ``event_arr`` and ``delta_arr``
    (whole seconds since the previous step as BIGINT, or their log1p when ``log_deltas``), padded with zeros on
    ``side`` to length n, and ``mask_arr`` (1 = real, 0 = pad; inverted when ``mask_pad_true``)."""
    s = _window_steps(df, n, keep, cols)
    d = F.log1p(F.col("gap_s").cast("double")) if log_deltas else F.col("gap_s")
    a = _collect(s, {"ev": F.col(cols.event), "dl": d}, cols)
    real, padv = (0, 1) if mask_pad_true else (1, 0)
    return a.select(
        cols.id,
        pad("ev", n, side, 0).alias("event_arr"),
        pad("dl", n, side, 0.0 if log_deltas else 0).alias("delta_arr"),
        pad_mask("ev", n, side, real, padv).alias("mask_arr"),
        F.size("ev").alias("n_real"),
    )


def pad_states(df: DataFrame, n: int = 50, cart_id: int = 11, checkout_id: int = 6, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """M1/M4: last n step states (hours since start, cart adds so far, checkouts so far), pre-padded
    with zero triples; a journey without rows (or NULL states) becomes all zeros."""
    from journeyflow.operators.features import step_states

    st = step_states(df, cart_id, checkout_id, cols)
    cnt = st.groupBy(cols.id).agg(F.count(F.lit(1)).alias("_n"))
    st = st.join(cnt, cols.id).where(F.col("step_index") > F.col("_n") - n).withColumnRenamed("step_index", "_step")
    state = F.array(F.coalesce(F.col("hours_since_start"), F.lit(0.0)),
                    F.coalesce(F.col("cart_adds_so_far").cast("double"), F.lit(0.0)),
                    F.coalesce(F.col("checkouts_so_far").cast("double"), F.lit(0.0)))
    a = _collect(st, {"s": state}, cols)
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return a.select(cols.id, F.concat(F.array_repeat(zero, F.greatest(F.lit(n) - F.size("s"), F.lit(0)).cast("int")), "s").alias("state_arr"))


def next_event_pairs(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """M9: (event, log1p gap) at step i -> target event and log1p gap at step i + 1.

    A lead is a lag in reverse order: the ordered scan on negated time gives the next step."""
    s = step_inputs(df, cols)
    s = s.withColumn("_neg", -F.col("us")).withColumn("_nev", -F.col(cols.event))
    nx = ordered_scan(s, cols.id, "_neg", ["_nev"], prev=[cols.event, "gap_s"])
    return nx.where(F.col(f"prev_{cols.event}").isNotNull()).select(
        cols.id, F.col("us"), F.col(cols.event).alias("event"), F.log1p(F.col("gap_s").cast("double")).alias("log_gap"),
        F.col(f"prev_{cols.event}").alias("next_event"), F.log1p(F.col("prev_gap_s").cast("double")).alias("next_log_gap"))
