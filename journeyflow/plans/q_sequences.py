"""Catalogue: array functions (J1-J10) and sequence tensors (M1-M4, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.functions import arrays as A
from journeyflow.operators import clean
from journeyflow.operators import sequences as seq
from journeyflow.plans.common import ev
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.schema import ORDER_INTENT_IDS

_OI = ", ".join(str(i) for i in ORDER_INTENT_IDS)


def _nested(spark, sf, b="j2"):
    return clean.nest_journeys(ev(spark, sf, b), success_id=28)


def _txt(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# journeys as ordered lists in DuckDB
_LISTS = """, n AS (SELECT id, list(ed_id ORDER BY us, ed_id) AS ids, list(us ORDER BY us, ed_id) AS uss FROM {b} GROUP BY id)"""


@query("j1_journey_ends", sql=with_ctes("j2") + _LISTS.format(b="j2") + """
SELECT id, len(ids) AS n_actions, ids[1] AS first_ed_id, ids[-1] AS last_ed_id,
       make_timestamp(uss[1]) AS start_time, make_timestamp(uss[-1]) AS end_time FROM n""")
def j1(spark, sf):
    n = _nested(spark, sf)
    return n.select("id", *A.journey_ends("journey")).select(
        "id", F.col("n_actions").cast("long").alias("n_actions"), "first_ed_id", "last_ed_id",
        F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"))


@query("j2_journey_arrays", sql=with_ctes("j1") + """, g AS (SELECT *, coalesce((us - lag(us) OVER w) // 1000000, 0) AS gap,
       (us - first_value(us) OVER w) // 1000000 AS el FROM j1 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id))
SELECT id, string_agg(CAST(ed_id AS VARCHAR), ',' ORDER BY us, ed_id) AS ids_text,
       string_agg(CAST(gap AS VARCHAR), ',' ORDER BY us, ed_id) AS gaps_text,
       string_agg(CAST(el AS VARCHAR), ',' ORDER BY us, ed_id) AS elapsed_text FROM g GROUP BY id""")
def j2(spark, sf):
    n = _nested(spark, sf, "j1")
    return n.select("id", _txt(A.journey_ids("journey")).alias("ids_text"), _txt(A.journey_gaps("journey")).alias("gaps_text"),
                    _txt(A.journey_elapsed("journey")).alias("elapsed_text"))


@query("j3_any_event", sql=with_ctes("j2") + """SELECT id, bool_or(ed_id = 28) AS has_success, bool_or(ed_id = 11) AS has_cart FROM j2 GROUP BY id""")
def j3(spark, sf):
    n = _nested(spark, sf)
    return n.select("id", A.any_event("journey", 28).alias("has_success"), A.any_event("journey", 11).alias("has_cart"))


@query("j4_count_where", sql=with_ctes("j2") + f"""SELECT id, CAST(count(*) FILTER (WHERE ed_id IN ({_OI})) AS INTEGER) AS n_order_intent FROM j2 GROUP BY id""")
def j4(spark, sf):
    n = _nested(spark, sf)
    return n.select("id", A.count_where(A.journey_ids("journey"), lambda x: x.isin(list(ORDER_INTENT_IDS))).alias("n_order_intent"))


@query("j5_prefix_before", sql=with_ctes("j1") + _LISTS.format(b="j1") + """
SELECT id, array_to_string(CASE WHEN list_position(ids, 28) IS NULL THEN ids ELSE ids[1:list_position(ids, 28) - 1] END, ',') AS prefix_text FROM n""")
def j5(spark, sf):
    n = _nested(spark, sf, "j1")
    return n.select("id", F.coalesce(_txt(A.prefix_before(A.journey_ids("journey"), 28)), F.lit("")).alias("prefix_text"))


@query("j6_keep_last_first", sql=with_ctes("j2") + _LISTS.format(b="j2") + """
SELECT id, array_to_string(ids[greatest(len(ids) - 4, 1):], ',') AS last5, array_to_string(ids[1:5], ',') AS first5 FROM n""")
def j6(spark, sf):
    n = _nested(spark, sf).select("id", A.journey_ids("journey").alias("ids"))
    return n.select("id", _txt(A.keep_last("ids", 5)).alias("last5"), _txt(A.keep_first("ids", 5)).alias("first5"))


@query("j7_distinct_size", sql=with_ctes("j2") + """SELECT id, CAST(count(DISTINCT ed_id) AS INTEGER) AS n_unique FROM j2 GROUP BY id""")
def j7(spark, sf):
    n = _nested(spark, sf)
    return n.select("id", A.distinct_size(A.journey_ids("journey")).alias("n_unique"))


@query("j8_pad_mask", sql=with_ctes("j1") + _LISTS.format(b="j1") + """, k AS (SELECT id, ids[greatest(len(ids) - 11, 1):] AS l FROM n)
SELECT id, array_to_string(list_concat(l, list_resize([]::INTEGER[], 12 - len(l), 0)), ',') AS right_padded,
       array_to_string(list_concat(list_resize([]::INTEGER[], 12 - len(l), 0), l), ',') AS left_padded,
       repeat('1,', len(l)) || repeat('0,', 12 - len(l)) AS mask FROM k""")
def j8(spark, sf):
    n = _nested(spark, sf, "j1").select("id", A.keep_last(A.journey_ids("journey"), 12).alias("l"))
    return n.select("id", _txt(A.pad("l", 12, "right")).alias("right_padded"), _txt(A.pad("l", 12, "left")).alias("left_padded"),
                    F.concat(F.array_join(F.transform(A.pad_mask("l", 12), lambda x: x.cast("string")), ","), F.lit(",")).alias("mask"))


@query("j9_array_stats", sql=with_ctes("j2") + """, g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000, 0) AS gap FROM j2)
SELECT id, min(gap) AS min_gap, max(gap) AS max_gap, CAST(sum(gap) AS DOUBLE) / count(gap) AS mean_gap, CAST(median(gap) AS DOUBLE) AS median_gap FROM g GROUP BY id""")
def j9(spark, sf):
    n = _nested(spark, sf).select("id", A.journey_gaps("journey").alias("g"))
    return n.select("id", F.array_min("g").alias("min_gap"), F.array_max("g").alias("max_gap"), A.array_mean("g").alias("mean_gap"),
                    A.array_median("g").alias("median_gap"))


@query("j10_vocab_size", sql=with_ctes("j1") + "SELECT max(ed_id) + 1 AS vocab_size FROM j1")
def j10(spark, sf):
    return ev(spark, sf, "j1").agg((F.max("ed_id") + 1).alias("vocab_size"))


def _seq_sql(b, n, keep, side, log, mask_pad_true=False):
    keep_cond = "rb <= {n}" if keep == "last" else "ra <= {n}"
    d = "round(ln(1 + gap), 6)" if log else "gap"
    z = "0.0" if log else "0"
    real, padv = ("0", "1") if mask_pad_true else ("1", "0")
    ev_txt = "string_agg(CAST(ed_id AS VARCHAR), ',' ORDER BY us, ed_id)"
    dl_txt = f"string_agg(CAST({d} AS VARCHAR), ',' ORDER BY us, ed_id)"
    if side == "right":
        e = f"{ev_txt} || repeat(',0', greatest({n} - count(*), 0))"
        dl = f"{dl_txt} || repeat(',{z}', greatest({n} - count(*), 0))"
        m = f"rtrim(repeat('{real},', count(*)) || repeat('{padv},', greatest({n} - count(*), 0)), ',')"
    else:
        e = f"repeat('0,', greatest({n} - count(*), 0)) || {ev_txt}"
        dl = f"repeat('{z},', greatest({n} - count(*), 0)) || {dl_txt}"
        m = f"rtrim(repeat('{padv},', greatest({n} - count(*), 0)) || repeat('{real},', count(*)), ',')"
    return with_ctes(b) + f""", g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us, ed_id)) // 1000000, 0) AS gap,
       row_number() OVER (PARTITION BY id ORDER BY us, ed_id) AS ra, row_number() OVER (PARTITION BY id ORDER BY us DESC, ed_id DESC) AS rb FROM {b})
SELECT id, {e} AS event_arr, {dl} AS delta_arr, {m} AS mask_arr, CAST(count(*) AS INTEGER) AS n_real
FROM g WHERE {keep_cond.format(n=n)} GROUP BY id"""


def _seq_txt(df):
    dl = A.array_text("delta_arr", 6) if dict(df.dtypes)["delta_arr"] == "array<double>" else _txt("delta_arr")
    return df.select("id", _txt("event_arr").alias("event_arr"), dl.alias("delta_arr"),
                     _txt("mask_arr").alias("mask_arr"), "n_real")


@query("m1_pad_sequences_pre", sql=_seq_sql("j2", 50, "last", "left", False))
def m1(spark, sf):
    return _seq_txt(seq.pad_sequences(ev(spark, sf, "j2"), 50, keep="last", side="left", log_deltas=False))


@query("m2_pad_sequences_tpp", sql=_seq_sql("j2", 128, "last", "right", True))
def m2(spark, sf):
    return _seq_txt(seq.pad_sequences(ev(spark, sf, "j2"), 128, keep="last", side="right", log_deltas=True))


@query("m3_pad_sequences_first", sql=_seq_sql("j1", 256, "first", "right", False, mask_pad_true=True))
def m3(spark, sf):
    return _seq_txt(seq.pad_sequences(ev(spark, sf, "j1"), 256, keep="first", side="right", log_deltas=False, mask_pad_true=True))


@query("m4_pad_states", sql=with_ctes("j2") + """, s AS (SELECT id, us, ed_id, row_number() OVER (PARTITION BY id ORDER BY us DESC, ed_id DESC) AS rb,
       round((us - min(us) OVER (PARTITION BY id)) / 3.6e9, 6) AS h,
       sum(CASE WHEN ed_id = 11 THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN ed_id = 6 THEN 1 ELSE 0 END) OVER w AS k
  FROM j2 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, repeat('0.0|0.0|0.0,', greatest(50 - count(*), 0))
       || string_agg(CAST(h AS VARCHAR) || '|' || CAST(CAST(c AS DOUBLE) AS VARCHAR) || '|' || CAST(CAST(k AS DOUBLE) AS VARCHAR), ',' ORDER BY us, ed_id) AS state_arr
FROM s WHERE rb <= 50 GROUP BY id""")
def m4(spark, sf):
    s = seq.pad_states(ev(spark, sf, "j2"), 50)
    return s.select("id", F.array_join(F.transform("state_arr", lambda t: F.array_join(
        F.transform(t, lambda x: F.round(x, 6).cast("string")), "|")), ",").alias("state_arr"))


@query("m9_next_event_pairs", sql=with_ctes("j1") + """, g AS (SELECT *, coalesce((us - lag(us) OVER w) // 1000000, 0) AS gap FROM j1 WINDOW w AS (PARTITION BY id ORDER BY us, ed_id))
SELECT id, us, ed_id AS event, ln(1 + gap) AS log_gap, lead(ed_id) OVER w AS next_event, ln(1 + lead(gap) OVER w) AS next_log_gap
FROM g WINDOW w AS (PARTITION BY id ORDER BY us, ed_id) QUALIFY lead(ed_id) OVER w IS NOT NULL""")
def m9(spark, sf):
    return seq.next_event_pairs(ev(spark, sf, "j1"))
