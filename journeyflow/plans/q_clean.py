"""Catalogue: sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.operators import clean
from journeyflow.plans.common import ev, flat, table
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.sources import files


@query("a4_read_projection", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def a4(spark, sf):
    return files.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                            where=F.col("o_orderstatus") == "F")


@query("a5_head_sample", sql="SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def a5(spark, sf):
    return files.head_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@query(
    "a7_table_profile",
    sql="""SELECT 'lineitem' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       CAST(count(*) FILTER (WHERE l_returnflag IS NULL) AS BIGINT) AS null_cells_l_returnflag FROM lineitem""",
)
def a7(spark, sf):
    return files.table_profile(table(spark, sf, "lineitem"), "lineitem", null_cols=["l_returnflag"])


@query("b1_dedup_events", sql=with_ctes("dup") + "SELECT DISTINCT id, event_timestamp, ed_id FROM dup")
def b1(spark, sf):
    return flat(clean.dedup_events(ev(spark, sf, "dup")))


@query(
    "b2_dedup_keep_first",
    sql=with_ctes("dup")
    + """SELECT id, event_timestamp, ed_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id, ed_id, event_timestamp ORDER BY event_id) AS rn FROM dup) WHERE rn = 1""",
)
def b2(spark, sf):
    from journeyflow.sources.bindings import dup_events

    d = clean.dedup_events(dup_events(spark, sf), keep="first", order=["event_id"])
    return d.select("id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "ed_id", "event_id")


@query(
    "b3_dedup_subset",
    sql=with_ctes("dup") + "SELECT DISTINCT split_part(id, '-', 1) AS user_key, event_timestamp FROM dup",
)
def b3(spark, sf):
    d = ev(spark, sf, "dup").withColumn("user_key", F.split_part(F.col("id"), F.lit("-"), F.lit(1)))
    return clean.dedup_events(d, subset=["user_key", "event_timestamp"]).select(
        "user_key", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"))


@query(
    "b4_dedup_report",
    sql=with_ctes("dup")
    + """SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT id, ed_id, event_timestamp FROM dup)) AS BIGINT) AS duplicate_rows,
       round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT id, ed_id, event_timestamp FROM dup))) * 100.0 / count(*), 6) AS duplicate_pct,
       CAST((SELECT count(*) FROM (SELECT DISTINCT id, ed_id, event_timestamp FROM dup)) AS BIGINT) AS remaining_rows
FROM dup""",
)
def b4(spark, sf):
    return clean.dedup_report(ev(spark, sf, "dup"))


@query(
    "b5_parse_ts_strict",
    sql="SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS TIMESTAMP) AS parsed FROM events",
)
def b5(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("txt"))
    return clean.parse_ts(e, "txt", out="parsed").select("event_id", F.col("parsed").cast("timestamp_ntz").alias("parsed"))


@query(
    "b6_parse_ts_lenient",
    sql="""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'not a time'
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS TIMESTAMP) AS parsed FROM events""",
)
def b6(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("not a time"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("txt"),
    )
    return clean.parse_ts(e, "txt", strict=False, out="parsed").select(
        "event_id", F.col("parsed").cast("timestamp_ntz").alias("parsed"))


@query("b7_to_naive", sql="SELECT event_id, ts FROM events")
def b7(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return clean.to_naive(e, "ts")


@query("b8_to_utc", sql="SELECT event_id, epoch_us(ts) AS ts_us FROM events")
def b8(spark, sf):
    e = clean.to_utc(table(spark, sf, "events").select("event_id", "ts"), "ts")
    return e.select("event_id", F.unix_micros("ts").alias("ts_us"))


_NEST_SQL = """SELECT id, CAST(count(*) AS BIGINT) AS n_steps,
       string_agg(CAST(ed_id AS VARCHAR) || '@' || CAST(us AS VARCHAR), ',' ORDER BY us, ed_id) AS journey_text{extra}
FROM {b} GROUP BY id"""


def _journey_text(df):
    return F.array_join(
        F.transform("journey", lambda x: F.concat(x["ed_id"].cast("string"), F.lit("@"),
                                                   F.unix_micros(x["event_timestamp"]).cast("string"))), ",")


@query("b9_nest_journeys", sql=with_ctes("j1") + _NEST_SQL.format(extra="", b="j1"))
def b9(spark, sf):
    n = clean.nest_journeys(ev(spark, sf, "j1"))
    return n.select("id", F.size("journey").cast("long").alias("n_steps"), _journey_text(n).alias("journey_text"))


@query(
    "b10_nest_success",
    sql=with_ctes("j2") + _NEST_SQL.format(extra=", bool_or(ed_id = 28) AS is_success", b="j2"),
)
def b10(spark, sf):
    n = clean.nest_journeys(ev(spark, sf, "j2"), success_id=28)
    return n.select("id", F.size("journey").cast("long").alias("n_steps"), _journey_text(n).alias("journey_text"), "is_success")


@query("b9_nest_chunks", sql=with_ctes("j2") + """, s AS (SELECT *, row_number() OVER w - 1 AS place, coalesce((us - lag(us) OVER w) // 1000000, 0) AS gap FROM j2 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id))
SELECT id, CAST(place // 4 AS BIGINT) AS chunk, CAST(min(place) AS BIGINT) AS n_before, CAST(count(*) AS BIGINT) AS n_steps, min(event_timestamp) AS first_time,
       string_agg(CAST(ed_id AS VARCHAR), ',' ORDER BY place) AS events, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY place) AS gaps,
       any_value(hit) AS is_success
FROM (SELECT s.*, max(CASE WHEN ed_id = 28 THEN 1 ELSE 0 END) OVER (PARTITION BY id) > 0 AS hit FROM s) GROUP BY id, place // 4""")
def b9c(spark, sf):
    n = clean.nest_chunks(ev(spark, sf, "j2"), 4, success_id=28, gaps=True)
    text = {k: F.array_join(F.col("journey")[k].cast("array<string>"), ",") for k in ("ed_id", "gap_s")}
    return n.select("id", "chunk", "n_before", F.size("journey").cast("long").alias("n_steps"), F.col("journey")[0]["event_timestamp"].cast("timestamp_ntz").alias("first_time"),
                    text["ed_id"].alias("events"), text["gap_s"].alias("gaps"), "is_success")


@query("b11_unnest_journeys", sql=with_ctes("j1") + "SELECT id, event_timestamp, ed_id FROM j1")
def b11(spark, sf):
    n = clean.nest_journeys(ev(spark, sf, "j1"))
    return flat(clean.unnest_journeys(n))


@query("b12_sort_journeys", sql=with_ctes("j2") + _NEST_SQL.format(extra="", b="j2"))
def b12(spark, sf):
    e = ev(spark, sf, "j2")
    # build each journey in reverse order, then sort it
    step = F.struct(F.col("event_timestamp"), F.col("ed_id"))
    n = e.groupBy("id").agg(F.sort_array(F.collect_list(step), asc=False).alias("journey"))
    s = clean.sort_journeys(n)
    return s.select("id", F.size("journey").cast("long").alias("n_steps"), _journey_text(s).alias("journey_text"))
