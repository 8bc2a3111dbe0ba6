"""Feature engineering (inventory L1-L15).

The static vector (L3-L10, 38 values) is one hash aggregate per id over flat events: the
per-event inputs (seconds since the journey start, gap to the previous event) come from a
per-id frame join and the skew-safe ordered scan, never from a collected list.
Times are exact whole seconds (the reference rounds them through float32; we do not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.functions.scalar import cyclic, safe_ratio
from journeyflow.operators.ordered import ordered_scan
from journeyflow.operators.snapshot import with_us
from journeyflow.schema import (
    APPLICATION_IDS,
    APPROVAL_IDS,
    DEFAULT_COLS,
    DOWNPAYMENT_IDS,
    FEATURE_MILESTONES,
    FIRST_PURCHASE_IDS,
    ORDER_INTENT_IDS,
    PROSPECTING_IDS,
    RATIO_EPS,
    SECONDS_PER_DAY,
    TRAILING_WINDOWS,
    US_PER_SEC,
    JourneyCols,
)

# --- fixed values: names of the static feature vector, in its order -------------------
STATIC_FEATURE_NAMES = (
    "log1p_journey_length",
    "log1p_total_elapsed_seconds",
    "log1p_last_gap_seconds",
    "log1p_mean_gap_seconds",
    "log1p_median_gap_seconds",
    "log1p_max_gap_seconds",
    "zero_gap_share",
    "log1p_unique_event_count",
    "event_diversity_ratio",
    "first_event_id",
    "last_event_id",
    "max_milestone_seen",
    "seen_application",
    "seen_approval",
    "seen_first_purchase",
    "seen_order_intent",
    "seen_downpayment",
    "seen_prospecting",
    "log1p_application_count",
    "log1p_first_purchase_count",
    "log1p_order_intent_count",
    "log1p_downpayment_count",
    "log1p_prospecting_count",
    "order_intent_share",
    "event_velocity_per_day",
    "application_velocity_per_day",
    "order_intent_velocity_per_day",
    "events_last_5h",
    "events_last_1d",
    "events_last_3d",
    "intent_last_5h",
    "intent_last_1d",
    "intent_last_3d",
    "log1p_seconds_since_last_application",
    "log1p_seconds_since_last_order_intent",
    "log1p_seconds_since_last_downpayment",
    "log1p_cutoff_elapsed_seconds",
    "log1p_seconds_since_last_event_at_cutoff",
)
# --- end of fixed values ---------------------------------------------------------------


def ratio_features(snap: DataFrame, eps: float = RATIO_EPS) -> DataFrame:
    """L1: velocity and ratio features of a K7 snapshot (denominators + eps)."""
    return snap.select(
        "*",
        safe_ratio("n_events_observed", "observed_duration_days", eps).alias("velocity_events_per_day"),
        safe_ratio("n_unique_event_types_observed", "observed_duration_days", eps).alias("velocity_unique_events_per_day"),
        safe_ratio("n_unique_event_types_observed", "n_events_observed", eps).alias("ratio_unique_to_total_events"),
        safe_ratio("days_since_last_event", "observed_duration_days", eps).alias("ratio_inactive_to_active_days"),
    )


def _whole_seconds(diff_us: Column) -> Column:
    return ((diff_us - diff_us % US_PER_SEC) / US_PER_SEC).cast("long")


def step_inputs(df: DataFrame, cols: JourneyCols = DEFAULT_COLS, index: str | None = None) -> DataFrame:
    """Per event: ``abs_s`` (whole seconds since the first event), ``gap_s`` (since the previous
    event, 0 first), ``total_s`` (abs of the last event), optionally the 1-based step ``index``
    -- via one frame join + one ordered scan."""
    df = with_us(df, cols)
    s = ordered_scan(df, cols.id, "us", [cols.event], prev=["us"], index=index, key_bounds=True, key_totals=index is not None)
    s = s.withColumnsRenamed({"key_first": "_start", "key_last": "_last"})
    return s.select(
        "*",
        _whole_seconds(F.col("us") - F.col("_start")).alias("abs_s"),
        F.coalesce(_whole_seconds(F.col("us") - F.col("prev_us")), F.lit(0).cast("long")).alias("gap_s"),
        _whole_seconds(F.col("_last") - F.col("_start")).alias("total_s"),
    )


def _in(c: Column, ids) -> Column:
    return c.isin(list(ids))


def static_features(
    df: DataFrame,
    at_cutoff: DataFrame | None = None,
    ids: DataFrame | None = None,
    cols: JourneyCols = DEFAULT_COLS,
    raw: bool = False,
) -> DataFrame:
    """L3-L10 (+L14): the 38-value static vector per id from the given (prefix) events.

    ``at_cutoff`` may carry ``cutoff_elapsed_seconds`` / ``seconds_since_last_event_at_cutoff``
    per id (default: total elapsed, and 0). ``ids`` lists journeys that must get a row even
    without events (all-zero vector, L14). ``raw`` also keeps the unlogged counts.
    """
    s = step_inputs(df, cols)
    ev = F.col(cols.event)
    total = F.first("total_s").cast("double")
    is_app, is_oi, is_dp = _in(ev, APPLICATION_IDS), _in(ev, ORDER_INTENT_IDS), _in(ev, DOWNPAYMENT_IDS)
    ms = F.lit(0)
    for k, v in sorted(FEATURE_MILESTONES.items()):
        ms = F.when(ev == k, F.lit(v)).otherwise(ms) if isinstance(ms, Column) else ms
    recent = {}
    for name, w in TRAILING_WINDOWS.items():
        cond = (F.col("total_s") <= 0) | (F.col("abs_s") >= F.col("total_s") - w)
        recent[f"events_last_{name}"] = F.count_if(cond).cast("double")
        recent[f"intent_last_{name}"] = F.count_if(cond & is_oi).cast("double")
    last = F.max(F.struct("us", cols.event, "gap_s"))
    first = F.min(F.struct("us", cols.event))
    g = s.groupBy(cols.id).agg(
        F.count(F.lit(1)).alias("length"),
        total.alias("total_elapsed"),
        last["gap_s"].cast("double").alias("last_gap"),
        F.avg("gap_s").alias("mean_gap"),
        F.median("gap_s").cast("double").alias("median_gap"),
        F.max("gap_s").cast("double").alias("max_gap"),
        F.avg((F.col("gap_s") == 0).cast("double")).alias("zero_gap_share"),
        F.size(F.collect_set(cols.event)).alias("unique_count"),
        first[cols.event].cast("double").alias("first_event_id"),
        last[cols.event].cast("double").alias("last_event_id"),
        F.max(ms).cast("double").alias("max_milestone_seen"),
        F.count_if(is_app).alias("application_count"),
        F.count_if(_in(ev, APPROVAL_IDS)).alias("approval_count"),
        F.count_if(_in(ev, FIRST_PURCHASE_IDS)).alias("first_purchase_count"),
        F.count_if(is_oi).alias("order_intent_count"),
        F.count_if(is_dp).alias("downpayment_count"),
        F.count_if(_in(ev, PROSPECTING_IDS)).alias("prospecting_count"),
        *[e.alias(n) for n, e in recent.items()],
        F.max(F.when(is_app, F.col("abs_s"))).alias("_last_app"),
        F.max(F.when(is_oi, F.col("abs_s"))).alias("_last_oi"),
        F.max(F.when(is_dp, F.col("abs_s"))).alias("_last_dp"),
    )
    if at_cutoff is not None:
        g = g.join(at_cutoff.select(cols.id, "cutoff_elapsed_seconds", "seconds_since_last_event_at_cutoff"), cols.id, "left")
    else:
        g = g.withColumn("cutoff_elapsed_seconds", F.lit(None).cast("double")).withColumn(
            "seconds_since_last_event_at_cutoff", F.lit(None).cast("double"))
    L, T = F.col("length").cast("double"), F.col("total_elapsed")
    days = F.greatest(T / SECONDS_PER_DAY, F.lit(1.0 / SECONDS_PER_DAY))

    def since(c: str) -> Column:
        return F.when(F.col(c).isNull(), T + SECONDS_PER_DAY).otherwise(F.greatest(T - F.col(c), F.lit(0.0)))

    ce = F.col("cutoff_elapsed_seconds")
    sl = F.col("seconds_since_last_event_at_cutoff")
    out = {
        "log1p_journey_length": F.log1p(L),
        "log1p_total_elapsed_seconds": F.log1p(T),
        "log1p_last_gap_seconds": F.log1p(F.col("last_gap")),
        "log1p_mean_gap_seconds": F.log1p(F.col("mean_gap")),
        "log1p_median_gap_seconds": F.log1p(F.col("median_gap")),
        "log1p_max_gap_seconds": F.log1p(F.col("max_gap")),
        "zero_gap_share": F.col("zero_gap_share"),
        "log1p_unique_event_count": F.log1p(F.col("unique_count").cast("double")),
        "event_diversity_ratio": F.col("unique_count") / F.greatest(L, F.lit(1.0)),
        "first_event_id": F.col("first_event_id"),
        "last_event_id": F.col("last_event_id"),
        "max_milestone_seen": F.col("max_milestone_seen"),
        "seen_application": (F.col("application_count") > 0).cast("double"),
        "seen_approval": (F.col("approval_count") > 0).cast("double"),
        "seen_first_purchase": (F.col("first_purchase_count") > 0).cast("double"),
        "seen_order_intent": (F.col("order_intent_count") > 0).cast("double"),
        "seen_downpayment": (F.col("downpayment_count") > 0).cast("double"),
        "seen_prospecting": (F.col("prospecting_count") > 0).cast("double"),
        "log1p_application_count": F.log1p(F.col("application_count").cast("double")),
        "log1p_first_purchase_count": F.log1p(F.col("first_purchase_count").cast("double")),
        "log1p_order_intent_count": F.log1p(F.col("order_intent_count").cast("double")),
        "log1p_downpayment_count": F.log1p(F.col("downpayment_count").cast("double")),
        "log1p_prospecting_count": F.log1p(F.col("prospecting_count").cast("double")),
        "order_intent_share": F.col("order_intent_count") / F.greatest(L, F.lit(1.0)),
        "event_velocity_per_day": L / days,
        "application_velocity_per_day": F.col("application_count") / days,
        "order_intent_velocity_per_day": F.col("order_intent_count") / days,
        **{n: F.col(n) for n in recent},
        "log1p_seconds_since_last_application": F.log1p(since("_last_app")),
        "log1p_seconds_since_last_order_intent": F.log1p(since("_last_oi")),
        "log1p_seconds_since_last_downpayment": F.log1p(since("_last_dp")),
        "log1p_cutoff_elapsed_seconds": F.log1p(F.when(ce.isNull() | F.isnan(ce), T).otherwise(F.greatest(ce, F.lit(0.0)))),
        "log1p_seconds_since_last_event_at_cutoff": F.log1p(F.when(sl.isNull() | F.isnan(sl), F.lit(0.0)).otherwise(F.greatest(sl, F.lit(0.0)))),
    }
    extra = ["length", "total_elapsed", "mean_gap", "application_count", "order_intent_count", "downpayment_count",
             "prospecting_count", "unique_count"] if raw else []
    res = g.select(cols.id, *[e.cast("double").alias(n) for n, e in out.items()], *extra)
    if ids is not None:
        res = ids.select(cols.id).join(res, cols.id, "left").select(
            cols.id, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in out], *extra)
    return res


def step_features(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Per-step features -- hour and day-of-week cyclic codes (day 1 = Monday .. 7),
    month, whole seconds since the previous step (0 first), 1-based step index."""
    df = with_us(df, cols)
    s = ordered_scan(df, cols.id, "us", [cols.event], prev=["us"], index="step_index")
    t = F.col(cols.ts)
    hs, hc = cyclic(F.hour(t), 24)
    dow = F.weekday(t) + 1
    ds, dc = cyclic(dow, 7)
    return s.select(
        cols.id, F.col(cols.ts).cast("timestamp_ntz").alias(cols.ts), cols.event,
        hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"),
        dow.alias("day_of_week"), F.month(t).alias("month"),
        F.coalesce(_whole_seconds(F.col("us") - F.col("prev_us")), F.lit(0).cast("long")).alias("delta_seconds"),
        F.col("step_index").cast("long").alias("step_index"),
    )


def step_states(df: DataFrame, cart_id: int = 11, checkout_id: int = 6, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """Per step (hours since the journey start, cart adds so far, checkouts so far)."""
    df = with_us(df, cols)
    start = df.groupBy(cols.id).agg(F.min("us").alias("_start"))
    s = ordered_scan(df, cols.id, "us", [cols.event], index="step_index", running={
        "cart_adds_so_far": (F.col(cols.event) == cart_id).cast("long"),
        "checkouts_so_far": (F.col(cols.event) == checkout_id).cast("long"),
    }).join(start, cols.id)
    return s.select(
        cols.id, F.col("step_index").cast("long").alias("step_index"), cols.event,
        ((F.col("us") - F.col("_start")) / 3.6e9).alias("hours_since_start"),
        F.col("cart_adds_so_far").cast("long").alias("cart_adds_so_far"),
        F.col("checkouts_so_far").cast("long").alias("checkouts_so_far"),
    )


def observed_sequences(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """``observed_sequence`` (event ids) and ``observed_time_deltas`` (whole seconds, first
    0) per id, in (ts, event) order. The arrays are the output, so they are collected here."""
    s = step_inputs(df, cols)
    arr = F.array_sort(F.collect_list(F.struct("us", cols.event, "gap_s")))
    g = s.groupBy(cols.id).agg(arr.alias("_a"))
    return g.select(cols.id, F.transform("_a", lambda x: x[cols.event]).alias("observed_sequence"),
                    F.transform("_a", lambda x: x["gap_s"]).alias("observed_time_deltas"))


def markov_features(df: DataFrame, cols: JourneyCols = DEFAULT_COLS) -> DataFrame:
    """The nine state-transition inputs: mean gap, elapsed, events, event types, highest
    milestone, downpayment / prospecting counts, last event, events in the last 3 days."""
    st = static_features(df, cols=cols, raw=True)
    return st.select(
        cols.id,
        F.col("mean_gap").alias("mean_gap_seconds"),
        F.col("total_elapsed").alias("elapsed_seconds"),
        F.col("length").cast("long").alias("n_events"),
        F.col("unique_count").cast("long").alias("n_unique_events"),
        F.col("max_milestone_seen").alias("max_milestone"),
        F.col("downpayment_count").cast("long").alias("downpayment_count"),
        F.col("prospecting_count").cast("long").alias("prospecting_count"),
        F.col("last_event_id").cast("int").alias("last_ed_id"),
        F.col("events_last_3d").cast("long").alias("events_last_3d"),
    )

