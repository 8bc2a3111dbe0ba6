"""Catalogue: projection, filter and schema operators (C1-C13, A3, A6, A8 round trips)."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import project as pj
from journeyflow.operators import snapshot as snap
from journeyflow.plans.common import defs, ev, flat, table
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.schema import EVENT_IDS


def _snap(spark, sf, b="j1"):
    return snap.snapshot(ev(spark, sf, b), defs(spark))


@query("c1_only_event", sql=with_ctes("j1") + "SELECT id, event_timestamp, ed_id FROM j1 WHERE ed_id = 28")
def c1(spark, sf):
    return pj.only_event(flat(ev(spark, sf, "j1")), 28)


@query("c2_keep_ids", sql=with_ctes("j1") + """SELECT id, event_timestamp, ed_id FROM j1
WHERE id IN (SELECT id FROM j1 WHERE ed_id = 28)""")
def c2(spark, sf):
    """All events of the journeys that reach the success event."""
    e = flat(ev(spark, sf, "j1"))
    return pj.keep_ids(e, pj.only_event(e, 28).select("id"))


@query("c3_min_length", sql=with_ctes("j1") + "SELECT id, event_timestamp, ed_id FROM j1 WHERE id IN (SELECT id FROM j1 GROUP BY id HAVING count(*) >= 2)")
def c3(spark, sf):
    return pj.min_length(flat(ev(spark, sf, "j1")), 2)


_SNAP_KEEP = ("id", "n_events_observed", "observed_duration_days", "max_milestone_seen")


@query("c4_drop_cols", sql=with_ctes("snap_j2") + "SELECT * EXCLUDE (" + ", ".join(
    ["cutoff_time", "journey_terminal_time", "journey_terminal_reason", "leaked_success"]
    + [f"count_ed_{k}" for k in EVENT_IDS] + [f"seen_ed_{k}" for k in EVENT_IDS]) + ") FROM snap_j2")
def c4(spark, sf):
    s = _snap(spark, sf, "j2")
    return pj.drop_cols(s, ["cutoff_time", "journey_terminal_time", "journey_terminal_reason", "leaked_success", "not_a_column"]
                        + [f"count_ed_{k}" for k in EVENT_IDS] + [f"seen_ed_{k}" for k in EVENT_IDS])


@query("c5_drop_like", sql=with_ctes("snap_j2") + "SELECT id, cutoff_time, journey_terminal_time, journey_terminal_reason, label_order_shipped, "
       "sampling_weight_days, n_events_observed, n_unique_event_types_observed, observed_duration_days, days_since_last_event, "
       "cutoff_hour_utc, cutoff_dayofweek_utc, cutoff_month_utc, cutoff_dayofyear_utc, first_ed_id, first_event_name, first_stage, "
       "last_ed_id, last_event_name, last_stage, leaked_success FROM snap_j2")
def c5(spark, sf):
    return pj.drop_like(_snap(spark, sf, "j2"), ["seen", "count"])


@query("c6_select_dtypes", sql=with_ctes("snap_j2") + "SELECT journey_terminal_reason, first_event_name, first_stage, last_event_name, last_stage FROM snap_j2")
def c6(spark, sf):
    s = _snap(spark, sf, "j2")
    return pj.select_dtypes(s, "string").drop("id")


@query("c7_select_prefix", sql=with_ctes("snap_j1") + "SELECT id, " + ", ".join(f"count_ed_{k}" for k in EVENT_IDS) + " FROM snap_j1")
def c7(spark, sf):
    return pj.select_prefix(_snap(spark, sf), "count_ed_", keep=["id"])


@query("c8_feature_columns", sql=with_ctes("snap_j2") + """SELECT id, n_events_observed, n_unique_event_types_observed, observed_duration_days, days_since_last_event,
       cutoff_hour_utc, cutoff_dayofweek_utc, cutoff_month_utc, cutoff_dayofyear_utc, first_ed_id, last_ed_id, max_milestone_seen, """
       + ", ".join(f"count_ed_{k}, seen_ed_{k}" for k in EVENT_IDS) + " FROM snap_j2")
def c8(spark, sf):
    s = _snap(spark, sf, "j2")
    return s.select("id", *pj.feature_columns(s))


@query("c9_drop_nulls", sql=with_ctes("snap_j1") + "SELECT id, last_stage, max_milestone_seen FROM snap_j1 WHERE last_stage IS NOT NULL AND max_milestone_seen IS NOT NULL")
def c9(spark, sf):
    return pj.drop_nulls(_snap(spark, sf).select("id", "last_stage", "max_milestone_seen"))


@query("c10_fill", sql=with_ctes("snap_j1") + """SELECT id, coalesce(last_stage, 'MISSING') AS last_stage,
       coalesce(CASE WHEN isinf(r) OR isnan(r) THEN NULL ELSE r END, 0.0) AS r, coalesce(max_milestone_seen, 0.0) AS max_milestone_seen
FROM (SELECT *, CASE WHEN observed_duration_days = 0 THEN CAST('Infinity' AS DOUBLE) ELSE n_events_observed / observed_duration_days END AS r FROM snap_j1)""")
def c10(spark, sf):
    s = _snap(spark, sf).select("id", "last_stage", "max_milestone_seen", F.when(F.col("observed_duration_days") == 0, F.lit(float("inf")))
                                .otherwise(F.col("n_events_observed") / F.col("observed_duration_days")).alias("r"))
    return pj.fill(s, "MISSING", 0)


@query("c11_cast_numeric", sql=with_ctes("snap_j2") + """SELECT id, CAST(seen_ed_28 AS INTEGER) AS seen_ed_28, epoch_us(cutoff_time) AS cutoff_time,
       CAST(n_events_observed AS DOUBLE) AS n_events_observed FROM snap_j2""")
def c11(spark, sf):
    s = _snap(spark, sf, "j2").select("id", "seen_ed_28", "cutoff_time", "n_events_observed")
    return pj.cast_numeric(s, ["seen_ed_28", "cutoff_time", "n_events_observed"])


@query("c12_align_schema", sql=with_ctes("snap_j1") + "SELECT n_events_observed, 0.0 AS momentum_3d, days_since_last_event, 0.0 AS velocity_events_per_day FROM snap_j1")
def c12(spark, sf):
    return pj.align_schema(_snap(spark, sf).drop("id"), ["n_events_observed", "momentum_3d", "days_since_last_event", "velocity_events_per_day"])


@query("c13_rename", sql=with_ctes("j1") + "SELECT id AS journey_id, event_timestamp AS time, ed_id AS event_definition_id FROM j1")
def c13(spark, sf):
    return pj.rename(flat(ev(spark, sf, "j1")), {"id": "journey_id", "event_timestamp": "time", "ed_id": "event_definition_id"})


@query("a6_write_read_roundtrip", sql=with_ctes("snap_j1") + "SELECT id, n_events_observed, last_stage FROM snap_j1")
def a6(spark, sf):
    """A6 + A4: write the snapshot as zstd parquet to the checkpoint folder and read it back."""
    import uuid

    from journeyflow.session import ensure_checkpoint_dir
    from journeyflow.sources import files

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-roundtrip-{uuid.uuid4().hex}"
    files.write_table(_snap(spark, sf).select("id", "n_events_observed", "last_stage"), path)
    return files.read_table(spark, path)


@query("a3_read_event_defs", sql="""SELECT event_type || ' of user ' || user_id AS event_name, CAST(user_id % 3 AS INTEGER) AS journey_id, CAST(max(event_id) AS INTEGER) AS ed_id,
       CASE WHEN count(*) % 4 > 1 THEN CAST(count(*) AS DOUBLE) END AS milestone_number, CASE WHEN event_type <> 'view' THEN event_type END AS stage
FROM events GROUP BY event_type, user_id""")
def a3(spark, sf):
    """A3: definitions derived from the events (one per type and user), written as CSV files with a
    UTF-8 BOM, blank and malformed milestones and blank stages, and read back."""
    import uuid

    from journeyflow.session import ensure_checkpoint_dir
    from journeyflow.sources import files

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-defs-{uuid.uuid4().hex}"
    n = F.count("*")
    milestone = F.when(n % 4 > 1, n.cast("string")).when(n % 4 == 1, F.lit("n/a"))
    made = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_definition_id"), milestone.alias("milestone_number"))
    out = made.select(F.concat("event_type", F.lit(" of user "), "user_id").alias("\ufeffevent_name"), (F.col("user_id") % 3).alias("journey_id"), "event_definition_id",
                      "milestone_number", F.when(F.col("event_type") != "view", F.col("event_type")).alias("stage"))
    out.write.mode("overwrite").option("header", True).csv(path)
    return files.read_event_defs(spark, path)


@query("a8_write_submission", sql=with_ctes("m1") + "SELECT id, p AS order_shipped FROM m1")
def a8(spark, sf):
    import uuid

    from journeyflow.session import ensure_checkpoint_dir
    from journeyflow.sources import files
    from journeyflow.sources.bindings import scores

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-sub-{uuid.uuid4().hex}"
    files.write_submission(scores(spark, sf, ("m1",)).select("id", F.col("p").alias("order_shipped")), path)
    return spark.read.schema("id string, order_shipped double").option("header", True).csv(path)


def _csv_path(spark, name):
    import uuid

    from journeyflow.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/jf-{name}-{uuid.uuid4().hex}"


def _write_raw_csv(spark, sf):
    """The J1 events in the reference's raw CSV layout (id, customer_id, ed_id, text timestamp)."""
    e = ev(spark, sf, "j1").select(
        "id", F.split_part(F.col("id"), F.lit("-"), F.lit(1)).alias("customer_id"), "ed_id",
        F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_timestamp"))
    path = _csv_path(spark, "raw-csv")
    e.write.option("header", True).csv(path)
    return path


@query("a1_read_events_csv", sql=with_ctes("j1") + "SELECT id, event_timestamp, ed_id FROM j1")
def a1(spark, sf):
    """A1 (+B5): lazy CSV scan with an explicit schema, then strict UTC parsing."""
    from journeyflow.operators.clean import parse_ts
    from journeyflow.sources import files

    raw = files.read_events_csv(spark, _write_raw_csv(spark, sf))
    p = parse_ts(raw, "event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return p.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id")


@query("a2_csv_success_counts", sql=with_ctes("dup") + """SELECT CAST(CAST(event_timestamp AS DATE) AS TIMESTAMP) AS day, CAST(count(*) AS BIGINT) AS daily_orders
FROM (SELECT DISTINCT id, event_timestamp, ed_id FROM dup) WHERE ed_id = 28 GROUP BY 1""")
def a2(spark, sf):
    """A2 + E17 + E18: raw CSV (with duplicates) scanned in parallel splits, de-duplicated
    globally (not per chunk), success events counted per day with partial aggregation."""
    from journeyflow.operators.clean import dedup_events, parse_ts
    from journeyflow.sources import files
    from journeyflow.sources.bindings import dup_events

    e = dup_events(spark, sf).select("id", F.split_part(F.col("id"), F.lit("-"), F.lit(1)).alias("customer_id"), "ed_id",
                                     F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_timestamp"))
    path = _csv_path(spark, "dup-csv")
    e.repartition(4).write.option("header", True).csv(path)
    raw = parse_ts(files.read_events_csv(spark, path), "event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    d = dedup_events(raw.drop("customer_id"))
    return d.where(F.col("ed_id") == 28).groupBy(F.to_date("event_timestamp").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("daily_orders"))


@query("a10_write_run_metadata")
def a10(spark, sf):
    """A10: best tier configuration written as one JSON line and read back."""
    import json

    from journeyflow.operators import metrics as mt
    from journeyflow.sources import files
    from journeyflow.sources.bindings import scores

    best = mt.tier_grid_search(scores(spark, sf, ("m1",)), (0.1, 0.2), (0.3, 0.4), (0.5, 0.6)).orderBy("tiered_logloss").limit(1)
    meta = best.select(F.to_json(F.struct("*")).alias("meta"))
    path = _csv_path(spark, "meta")
    meta.coalesce(1).write.mode("overwrite").text(path)
    del json, files
    return spark.read.text(path).select(F.from_json("value", "tier1_threshold double, tier2_threshold double, tier3_threshold double, tiered_logloss double").alias("m")).select("m.*")


@query("a10_metadata_facts", sql=with_ctes("m1") + "SELECT CAST(1 AS BIGINT) AS n_lines, TRUE AS same_after_read, TRUE AS best_of_grid FROM (SELECT count(*) FROM m1)")
def a10f(spark, sf):
    """A10: the best configuration is the grid's first row, and reads back as it was written."""
    from journeyflow.operators import metrics as mt
    from journeyflow.sources.bindings import scores

    grid = mt.tier_grid_search(scores(spark, sf, ("m1",)), (0.1, 0.2), (0.3, 0.4), (0.5, 0.6))
    path = _csv_path(spark, "meta")
    grid.orderBy("tiered_logloss", "tier1_threshold", "tier2_threshold", "tier3_threshold").limit(1).select(F.to_json(F.struct("*")).alias("meta")).coalesce(1).write.mode("overwrite").text(path)
    kind = "tier1_threshold double, tier2_threshold double, tier3_threshold double, tiered_logloss double"
    back = spark.read.text(path).select(F.from_json("value", kind).alias("m")).select("m.*")
    least = grid.agg(F.min("tiered_logloss").alias("least"), F.min_by(F.struct("tier1_threshold", "tier2_threshold", "tier3_threshold"), F.struct("tiered_logloss", "tier1_threshold", "tier2_threshold", "tier3_threshold")).alias("at"))
    same = (F.col("at.tier1_threshold") == F.col("tier1_threshold")) & (F.col("at.tier2_threshold") == F.col("tier2_threshold")) & (F.col("at.tier3_threshold") == F.col("tier3_threshold"))
    return back.crossJoin(least).agg(F.count("*").alias("n_lines"), F.bool_and(same).alias("same_after_read"), F.bool_and(F.col("tiered_logloss") == F.col("least")).alias("best_of_grid"))


@query("h2_align_two_sources", sql=with_ctes("j1", "j2") + """SELECT id, ed_id, 0.0 AS weight, 'j1' AS origin FROM j1 UNION ALL
SELECT id, ed_id, CAST(us % 7 AS DOUBLE) AS weight, 'j2' AS origin FROM j2""")
def h2(spark, sf):
    """H2: sources with different columns are aligned to one schema and stacked."""
    columns = ["id", "ed_id", "weight", "origin"]
    one = ev(spark, sf, "j1").withColumn("origin", F.lit("j1"))
    two = ev(spark, sf, "j2").withColumn("weight", (F.col("us") % 7).cast("double")).withColumn("origin", F.lit("j2"))
    return pj.align_schema(one, columns).unionByName(pj.align_schema(two, columns))
