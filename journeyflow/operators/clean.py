"""Cleaning and journey construction (inventory B1-B12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.operators.ordered import ordered_scan
from journeyflow.operators.snapshot import with_us
from journeyflow.schema import DEFAULT_COLS, SUCCESS_ID, JourneyCols


def dedup_events(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "any",
    order: Sequence[str] | None = None,
    cols: JourneyCols = DEFAULT_COLS,
) -> DataFrame:
    """Drop duplicate events on ``subset`` (default id, event, timestamp).

    ``keep="any"`` is a hash aggregate (partial de-dup before the shuffle, key includes the
    timestamp so a hot id still spreads). ``keep="first"`` keeps the first row in ``order``.
    """
    subset = list(subset or [cols.id, cols.event, cols.ts])
    if keep == "any":
        return df.dropDuplicates(subset)
    if not order:
        raise ValueError("keep='first' needs an order")
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_report(df: DataFrame, subset: Sequence[str] | None = None, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Total rows, duplicate rows, duplicate percent and remaining rows."""
    subset = list(subset or [cols.id, cols.event, cols.ts])
    per_key = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("long").alias("total_rows"),
        (F.sum("_n") - F.count(F.lit(1))).cast("long").alias("duplicate_rows"),
        F.round((F.sum("_n") - F.count(F.lit(1))) * 100.0 / F.sum("_n"), 6).alias("duplicate_pct"),
        F.count(F.lit(1)).cast("long").alias("remaining_rows"),
    )


def parse_ts(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True, out: str | None = None) -> DataFrame:
    """Parse a text timestamp as UTC. Strict raises on bad text; lenient gives NULL."""
    out = out or col
    if strict:
        parsed = F.to_timestamp(F.col(col), fmt) if fmt else F.to_timestamp(F.col(col))
    else:
        parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(out, parsed)


def to_naive(df: DataFrame, col: str) -> DataFrame:
    """Drop the time zone (UTC wall clock as TIMESTAMP_NTZ)."""
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


def to_utc(df: DataFrame, col: str) -> DataFrame:
    """As a UTC instant (TIMESTAMP, microseconds)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def nest_journeys(df: DataFrame, success_id: int | None = None, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """One row per id with the journey as a sorted array of (timestamp, event) structs.

    The array *is* the output (interchange format of the reference); every analytic operator
    in this library works on the flat events instead. ``success_id`` adds ``is_success``.
    """
    step = F.struct(F.col(cols.ts).alias(cols.ts), F.col(cols.event).alias(cols.event))
    aggs = [F.array_sort(F.collect_list(step)).alias("journey")]
    if success_id is not None:
        aggs.append(F.bool_or(F.col(cols.event) == success_id).alias("is_success"))
    return df.groupBy(cols.id).agg(*aggs)


CHUNK_STEPS = 4096


def nest_chunks(df: DataFrame, steps: int = CHUNK_STEPS, success_id: int | None = None, gaps: bool = False, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """B9/B10/L13 for journeys of any length: rows (id, chunk, n_before, journey), arrays of ``steps``
    events at most, in order.

    A chunk's number follows from the places of its events in (timestamp, event) order, found by
    the ordered scan, so it does not depend on partitions, a journey that holds a third of all
    rows is many rows, and appending events changes no earlier chunk. ``success_id`` adds
    ``is_success`` (of the whole journey), ``gaps`` the seconds since the event before, across
    chunks too.
    """
    e = with_us(df, cols)
    totals = {"_hits": (F.col(cols.event) == success_id).cast("long")} if success_id is not None else {}
    s = ordered_scan(e, cols.id, "us", [cols.event], prev=["us"] if gaps else [], running=totals, index="_step", key_totals=bool(totals))
    at = F.col("_step") - 1
    step = [F.col("_step"), F.col(cols.ts).alias(cols.ts), F.col(cols.event).alias(cols.event)]
    step += [F.coalesce(F.floor((F.col("us") - F.col("prev_us")) / 1_000_000), F.lit(0)).alias("gap_s")] if gaps else []
    grouped = s.groupBy(cols.id, F.floor(at / steps).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(*step))).alias("_a"), *([F.max("_hits_total").alias("_total")] if totals else []))
    names = [cols.ts, cols.event, *(["gap_s"] if gaps else [])]
    return grouped.select(cols.id, "chunk", (F.col("chunk") * steps).alias("n_before"), F.transform("_a", lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("journey"),
                          *([(F.col("_total") > 0).alias("is_success")] if totals else []))


def unnest_journeys(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Journey array back to one row per event."""
    rest = [c for c in df.columns if c != "journey"]
    return df.select(*rest, F.inline("journey"))


def sort_journeys(df: DataFrame) -> DataFrame:
    """Sort each journey array by (timestamp, event)."""
    return df.withColumn("journey", F.array_sort("journey"))


def success_flag(cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID):
    return F.col(cols.event) == success_id
