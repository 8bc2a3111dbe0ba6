"""The snapshot as of every event, and scores along it (inventory K12)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyflow.operators.ordered import ordered_scan
from journeyflow.operators.snapshot import with_us
from journeyflow.schema import DEFAULT_COLS, EVENT_DEFINITIONS, EVENT_IDS, US_PER_DAY, JourneyCols, from_us


def timeline_states(df: DataFrame, ids: DataFrame | None = None, event_ids: Sequence[int] = EVENT_IDS, unique: bool = True,
                    cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """One row per event with the snapshot's features (K7 names) cut right after that event.

    ``ids`` (a table with the id column) restricts it to chosen journeys, ``event_ids`` the counted
    events; without ``unique`` the number of event types, which takes a scan of its own, is left out. Counts, the number of event types and the highest milestone are running sums of one
    ordered scan; an event type counts when it first occurs. Events of one moment follow each
    other by event id, so the last of them has the state of a snapshot cut at that moment.
    """
    e = with_us(df, cols)
    if ids is not None:
        e = e.join(ids.select(cols.id).distinct(), cols.id, "left_semi")
    milestones: dict[float, list[int]] = {}
    for _, _, event, level, _ in EVENT_DEFINITIONS:
        if level is not None:
            milestones.setdefault(float(level), []).append(event)
    # the first row of each event type; equal rows are told apart by the rank among them
    typed = ordered_scan(e, [cols.id, cols.event], "us", [], index="_nth") if unique else e
    running = {f"count_ed_{k}": (F.col(cols.event) == k).cast("long") for k in event_ids}
    running |= {f"_m{i}": F.col(cols.event).isin(which).cast("long") for i, which in enumerate(milestones.values())}
    types = "n_unique_event_types_observed"
    if unique:
        running[types] = (F.col("_nth") == 1).cast("long")
    s = ordered_scan(typed, cols.id, "us", [cols.event, *(["_nth"] if unique else [])], running=running, index="_step", key_bounds=True)
    start = e.groupBy(cols.id).agg(F.min(F.struct("us", cols.event))[cols.event].alias("first_ed_id"))
    s = s.join(start.withColumnRenamed(cols.id, "_id"), F.col(cols.id) == F.col("_id"))
    seen = [F.when(F.col(f"_m{i}") > 0, F.lit(level)) for i, level in enumerate(milestones)]
    at = from_us("us")
    return s.select(
        cols.id, F.col("_step").cast("long").alias("step"), at.alias("cutoff_time"), F.col("_step").cast("long").alias("n_events_observed"),
        *([F.col(types).cast("long").alias(types)] if unique else []),
        ((F.col("us") - F.col("key_first")) / F.lit(float(US_PER_DAY))).alias("observed_duration_days"), F.lit(0.0).alias("days_since_last_event"),
        F.hour(at).alias("cutoff_hour_utc"), F.weekday(at).alias("cutoff_dayofweek_utc"), F.month(at).alias("cutoff_month_utc"), F.dayofyear(at).alias("cutoff_dayofyear_utc"),
        "first_ed_id", F.col(cols.event).alias("last_ed_id"), F.greatest(*seen).alias("max_milestone_seen"),
        *[c for k in event_ids for c in (F.col(f"count_ed_{k}").cast("long").alias(f"count_ed_{k}"), (F.col(f"count_ed_{k}") > 0).alias(f"seen_ed_{k}"))])


def score_timeline(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], ids: DataFrame | None = None, event_ids: Sequence[int] = EVENT_IDS,
                   unique: bool = True, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """The states with ``p`` from any scorer (a function that adds it, a fitted model's ``ml_scorer``)."""
    return scorer(timeline_states(df, ids, event_ids, unique, cols))
