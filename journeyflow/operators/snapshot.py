"""Journey labelling, truncation and leak-free snapshots (inventory K1-K13).

Plan shape at scale (no per-id window on the raw events):

* ``journey_frame``: one partial+final hash aggregate per id (start, last, first success);
* the frame is joined back to the events on id (sort-merge; AQE splits a hot id);
* the observed prefix is a filter on the joined cutoff; snapshot fields are one more
  aggregate on the already id-clustered rows; event names come from a broadcast of the
  fixed-size event dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.functions.scalar import hash_uniform
from journeyflow.operators.ordered import ordered_scan, session_numbers
from journeyflow.operators.project import bounded_broadcast
from journeyflow.schema import (
    DEFAULT_COLS,
    EVENT_IDS,
    INACTIVITY_DAYS,
    SUCCESS_ID,
    US_PER_DAY,
    JourneyCols,
    from_us,
    to_us,
)


def with_us(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Make sure the BIGINT microsecond column ``us`` exists."""
    return df if "us" in df.columns else df.withColumn("us", to_us(cols.ts))


def journey_frame(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """One row per id: start_us, last_us, n_actions, success_us (first success, NULL if none)."""
    df = with_us(df, cols)
    return df.groupBy(cols.id).agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("n_actions"),
        F.min(F.when(F.col(cols.event) == success_id, F.col("us"))).alias("success_us"),
    )


def journey_status(
    df: DataFrame,
    endpoint: str | None = None,
    inactivity_days: int = INACTIVITY_DAYS,
    cols: JourneyCols = DEFAULT_COLS,
    success_id: int = SUCCESS_ID,
) -> DataFrame:
    """K1: success / unsuccessful / ongoing at an endpoint (default: the log's last timestamp).

    success = the journey reached the success event by the endpoint; unsuccessful = no event
    in the ``inactivity_days`` before the endpoint; otherwise ongoing.
    """
    df = with_us(df, cols)
    if endpoint is not None:
        end_us = to_us(F.lit(endpoint).cast("timestamp"))
        df = df.where(F.col("us") <= end_us)
        end = df.sparkSession.range(1).select(end_us.alias("end_us"))
    else:
        end = df.agg(F.max("us").alias("end_us"))  # one row: broadcast is bounded
    fr = journey_frame(df, cols, success_id).crossJoin(F.broadcast(end))
    status = (
        F.when(F.col("success_us").isNotNull(), F.lit("success"))
        .when(F.col("end_us") - F.col("last_us") >= inactivity_days * US_PER_DAY, F.lit("unsuccessful"))
        .otherwise(F.lit("ongoing"))
    )
    return fr.select(
        cols.id,
        status.alias("status"),
        from_us("last_us").alias("last_event_time"),
        from_us("end_us").alias("endpoint_time"),
    )


def _terminal_exprs(inactivity_days: int) -> dict[str, Column]:
    label = F.col("success_us").isNotNull()
    terminal = F.when(label, F.col("success_us")).otherwise(F.col("last_us") + F.lit(inactivity_days * US_PER_DAY))
    return {
        "label_order_shipped": label.cast("int"),
        "terminal_us": terminal,
        "journey_terminal_reason": F.when(label, F.lit("success")).otherwise(F.lit(f"inactive_{inactivity_days}d")),
    }


def label_journeys(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """K2: label (1 when the success event occurs) and first success time."""
    fr = journey_frame(df, cols, success_id)
    return fr.select(
        cols.id,
        F.col("success_us").isNotNull().cast("int").alias("label_order_shipped"),
        from_us("success_us").alias("first_success_time"),
        "n_actions",
    )


def cutoff_frame(
    df: DataFrame,
    seed: int = 42,
    cols: JourneyCols = DEFAULT_COLS,
    success_id: int = SUCCESS_ID,
    inactivity_days: int = INACTIVITY_DAYS,
    frame: DataFrame | None = None,
) -> DataFrame:
    """K3-K5 on the journey frame: terminal time and reason, sampling weight, seeded cutoff.

    * terminal = first success, else last event + ``inactivity_days``;
    * weight = max(1, ceil(days from start to terminal));
    * cutoff = start + floor(u * (terminal - 1 us - start)), u = hash_uniform(id, seed);
      the start itself when that interval is empty.
    """
    fr = frame if frame is not None else journey_frame(df, cols, success_id)
    t = _terminal_exprs(inactivity_days)
    fr = fr.select("*", *[e.alias(n) for n, e in t.items()])
    span_days = F.greatest((F.col("terminal_us") - F.col("start_us")) / F.lit(float(US_PER_DAY)), F.lit(0.0))
    upper = F.col("terminal_us") - F.lit(1)
    u = hash_uniform(F.col(cols.id), seed)
    cutoff = F.when(upper <= F.col("start_us"), F.col("start_us")).otherwise(
        F.col("start_us") + F.floor(u * (upper - F.col("start_us")).cast("double")).cast("long")
    )
    return fr.select(
        "*",
        F.greatest(F.lit(1), F.ceil(span_days)).cast("int").alias("sampling_weight_days"),
        cutoff.alias("cutoff_us"),
    )


def terminal(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, inactivity_days: int = INACTIVITY_DAYS) -> DataFrame:
    """K3: terminal time and reason per journey."""
    fr = journey_frame(df, cols)
    t = _terminal_exprs(inactivity_days)
    return fr.select(
        cols.id,
        t["label_order_shipped"].alias("label_order_shipped"),
        from_us(t["terminal_us"]).alias("journey_terminal_time"),
        t["journey_terminal_reason"].alias("journey_terminal_reason"),
    )


def sampling_weight(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """K4: max(1, ceil(days from the first event to the terminal time))."""
    return cutoff_frame(df, cols=cols).select(cols.id, "sampling_weight_days")


def choose_cutoff(df: DataFrame, seed: int = 42, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """K5: seeded uniform cutoff in [start, terminal - 1 us] per journey."""
    fr = cutoff_frame(df, seed, cols)
    return fr.select(cols.id, from_us("start_us").alias("start_time"), from_us("cutoff_us").alias("cutoff_time"),
                     from_us("terminal_us").alias("journey_terminal_time"))


def observed_prefix(df: DataFrame, seed: int = 42, cols: JourneyCols = DEFAULT_COLS, frame: DataFrame | None = None) -> DataFrame:
    """K6: events with ``ts <= cutoff`` of their journey, with the journey frame columns attached.

    Equi-join on id with the per-id frame (a range residual would need no join at all in a
    window, but that puts a hot id in one task; the join lets AQE split it).
    """
    df = with_us(df, cols)
    fr = frame if frame is not None else cutoff_frame(df, seed, cols)
    return df.join(fr, cols.id, "inner").where(F.col("us") <= F.col("cutoff_us"))


def event_pivot_exprs(ids: Sequence[int] = EVENT_IDS, cols: JourneyCols = DEFAULT_COLS) -> list[Column]:
    """K8 aggregate expressions: count_ed_k and seen_ed_k for a fixed id list (no discovered pivot).

    Written as SQL expression text: one call to the JVM per expression instead of one per
    Column operation (the plan is identical)."""
    out = []
    for k in ids:
        c = f"count_if(`{cols.event}` = {int(k)})"
        out += [F.expr(f"CAST({c} AS BIGINT) AS count_ed_{int(k)}"), F.expr(f"{c} > 0 AS seen_ed_{int(k)}")]
    return out


def event_pivot(df: DataFrame, ids: Sequence[int] = EVENT_IDS, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """K8: per-id event counts and seen flags."""
    return df.groupBy(cols.id).agg(*event_pivot_exprs(ids, cols))


def snapshot(
    df: DataFrame,
    defs: DataFrame,
    seed: int = 42,
    ids: Sequence[int] = EVENT_IDS,
    cols: JourneyCols = DEFAULT_COLS,
    pivot: bool = True,
) -> DataFrame:
    """K7: the leak-free training snapshot of every journey, cut at its seeded cutoff.

    Journeys with no event at or before the cutoff are skipped (cannot happen: the cutoff is
    never before the first event). ``leaked_success`` flags the journeys whose first event is
    the success itself (their cutoff is the start, so the success is observed).
    """
    df = with_us(df, cols)
    d = bounded_broadcast(defs)
    ms = d.select(F.col("ed_id").alias(cols.event), F.col("milestone_number").alias("_ms"))
    obs = observed_prefix(df, seed, cols).join(ms, cols.event, "left")
    first = F.min(F.struct("us", cols.event))
    last = F.max(F.struct("us", cols.event))
    aggs = [
        F.first("cutoff_us").alias("cutoff_us"),
        F.first("terminal_us").alias("terminal_us"),
        F.first("journey_terminal_reason").alias("journey_terminal_reason"),
        F.first("label_order_shipped").alias("label_order_shipped"),
        F.first("sampling_weight_days").alias("sampling_weight_days"),
        F.count(F.lit(1)).alias("n_events_observed"),
        F.size(F.collect_set(cols.event)).alias("n_unique_event_types_observed"),
        first["us"].alias("_first_us"),
        first[cols.event].alias("first_ed_id"),
        last["us"].alias("_last_us"),
        last[cols.event].alias("last_ed_id"),
        F.max("_ms").alias("max_milestone_seen"),
        F.bool_or(F.col(cols.event) == SUCCESS_ID).alias("leaked_success"),
    ]
    if pivot:
        aggs += event_pivot_exprs(ids, cols)
    g = obs.groupBy(cols.id).agg(*aggs)
    cutoff_ts = from_us("cutoff_us")
    names = d.select(F.col("ed_id"), "event_name", "stage")
    fn = names.select(F.col("ed_id").alias("first_ed_id"), F.col("event_name").alias("first_event_name"), F.col("stage").alias("first_stage"))
    ln = names.select(F.col("ed_id").alias("last_ed_id"), F.col("event_name").alias("last_event_name"), F.col("stage").alias("last_stage"))
    g = g.join(fn, "first_ed_id", "left").join(ln, "last_ed_id", "left")
    head = [
        F.col(cols.id),
        cutoff_ts.alias("cutoff_time"),
        from_us("terminal_us").alias("journey_terminal_time"),
        "journey_terminal_reason",
        "label_order_shipped",
        "sampling_weight_days",
        F.col("n_events_observed").cast("long").alias("n_events_observed"),
        F.col("n_unique_event_types_observed").cast("long").alias("n_unique_event_types_observed"),
        F.greatest((F.col("cutoff_us") - F.col("_first_us")) / F.lit(float(US_PER_DAY)), F.lit(0.0)).alias("observed_duration_days"),
        F.greatest((F.col("cutoff_us") - F.col("_last_us")) / F.lit(float(US_PER_DAY)), F.lit(0.0)).alias("days_since_last_event"),
        F.hour(cutoff_ts).alias("cutoff_hour_utc"),
        F.weekday(cutoff_ts).alias("cutoff_dayofweek_utc"),
        F.month(cutoff_ts).alias("cutoff_month_utc"),
        F.dayofyear(cutoff_ts).alias("cutoff_dayofyear_utc"),
        "first_ed_id",
        "first_event_name",
        "first_stage",
        "last_ed_id",
        "last_event_name",
        "last_stage",
        "max_milestone_seen",
        "leaked_success",
    ]
    tail = []
    if pivot:
        for k in ids:
            tail += [f"count_ed_{k}", f"seen_ed_{k}"]
    return g.select(*head, *tail)


def prefix_snapshot(df: DataFrame, seed: int = 42, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """K9: prefix-length snapshot.

    Usable events = events before the first success (all events when none), success events
    excluded. Journeys with fewer than 2 usable events are skipped. The prefix length is
    ``max(2, 1 + floor(u * n))`` with u = hash_uniform(id, seed). Returns one row per event of
    the chosen prefix (``step`` 1-based) with the per-journey snapshot columns.
    """
    df = with_us(df, cols)
    first_success = df.groupBy(cols.id).agg(F.min(F.when(F.col(cols.event) == success_id, F.col("us"))).alias("success_us"))
    usable = df.join(first_success, cols.id, "inner").where(
        (F.col(cols.event) != success_id) & (F.col("success_us").isNull() | (F.col("us") < F.col("success_us"))))
    # step index and the number of usable events come from the same two-level scan
    stepped = ordered_scan(usable, cols.id, "us", [cols.event], index="step", key_totals=True)
    n = F.col("step_total")
    k = F.greatest(F.lit(2), F.lit(1) + F.floor(hash_uniform(F.col(cols.id), seed) * n).cast("long"))
    return (
        stepped.where((n >= 2) & (F.col("step") <= k))
        .select("*", n.alias("n_usable"), k.alias("prefix_length"),
                F.col("success_us").isNotNull().cast("int").alias("label_order_shipped"))
        .drop("step_total", "success_us")
    )


def prefix_snapshot_summary(df: DataFrame, seed: int = 42, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """K9 per journey: label, elapsed seconds of the prefix, n events (F5 shape without the array)."""
    p = prefix_snapshot(df, seed, cols)
    g = p.groupBy(cols.id).agg(
        F.first("label_order_shipped").alias("label_order_shipped"),
        F.min("us").alias("_a"),
        F.max("us").alias("_b"),
        F.count(F.lit(1)).alias("n_events_observed"),
    )
    el = F.greatest((F.col("_b") - F.col("_a")) / F.lit(1e6), F.lit(0.0))
    return g.select(
        cols.id,
        "label_order_shipped",
        el.alias("cutoff_elapsed_seconds"),
        F.lit(0.0).alias("seconds_since_last_event_at_cutoff"),
        el.alias("observed_duration_seconds"),
        F.col("n_events_observed").cast("long").alias("n_events_observed"),
    )


def open_prefix(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, success_id: int = SUCCESS_ID) -> DataFrame:
    """The events strictly before the first success (in (ts, event) order) of successful
    journeys; unsuccessful journeys keep all events."""
    df = with_us(df, cols)
    first = df.where(F.col(cols.event) == success_id).groupBy(cols.id).agg(
        F.min(F.struct("us", cols.event)).alias("_fs")
    )
    j = df.join(first, cols.id, "left")
    before = F.col("_fs").isNull() | (F.struct("us", cols.event) < F.col("_fs"))
    return j.where(before).drop("_fs")


def oversample_by_days(df: DataFrame, seed: int = 42, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """A journey of N (weight) days gives N cutoffs, each with its own seed ``seed + copy``.

    Returns (id, copy, cutoff_time). The explode is per journey row (bounded by its weight).
    """
    fr = cutoff_frame(df, seed, cols)
    ex = fr.select(cols.id, "start_us", "terminal_us", F.explode(F.sequence(F.lit(1), F.col("sampling_weight_days"))).alias("copy"))
    upper = F.col("terminal_us") - 1
    u = hash_uniform(F.col(cols.id), (F.lit(seed) + F.col("copy")).cast("string"))
    cut = F.when(upper <= F.col("start_us"), F.col("start_us")).otherwise(
        F.col("start_us") + F.floor(u * (upper - F.col("start_us")).cast("double")).cast("long")
    )
    return ex.select(cols.id, F.col("copy").cast("int").alias("copy"), from_us(cut).alias("cutoff_time"))


def sessionize(df: DataFrame, gap_seconds: int, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Split each journey into sessions at gaps above ``gap_seconds``; adds ``session``
    (1-based) via the skew-safe ordered scan."""
    return session_numbers(with_us(df, cols), cols.id, "us", [cols.event], gap_seconds * 1_000_000, name="session")


def session_summary(df: DataFrame, gap_seconds: int, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """K13 per session: start, end, number of events."""
    s = sessionize(df, gap_seconds, cols)
    return s.groupBy(cols.id, "session").agg(
        from_us(F.min("us")).alias("session_start"),
        from_us(F.max("us")).alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
    )
