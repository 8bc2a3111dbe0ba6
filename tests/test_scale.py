"""Scale properties: skew-safe scans equal the plain window answer, results do not depend on
partitioning, filters and projections reach the scan, no unpartitioned window on events."""

import random

import pytest
from conftest import SF_CHECK
from pyspark.sql import Window
from pyspark.sql import functions as F

from journeyflow.operators.ordered import ordered_scan, session_numbers
from journeyflow.plans.registry import all_queries


def _hot_events(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):  # one hot key with most rows, spread over many tiny buckets
        k = "hot" if i % 3 else f"k{i % 17}"
        rows.append((k, rnd.randrange(0, 10_000_000), rnd.randrange(0, 5)))
    return spark.createDataFrame(rows, "id string, us long, ed int")


def test_ordered_scan_equals_window(spark):
    df = _hot_events(spark)
    got = ordered_scan(df, "id", "us", ["ed"], prev=["us"], index="step", bucket_us=50_000,
                       running={"n5": (F.col("ed") == 4).cast("long")})
    w = Window.partitionBy("id").orderBy("us", "ed")
    ref = df.select("*", F.lag("us").over(w).alias("prev_us"), F.row_number().over(w).alias("step"),
                    F.sum((F.col("ed") == 4).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n5"))
    cols = ["id", "us", "ed", "prev_us", "step", "n5"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())


def test_session_numbers_equal_window(spark):
    df = _hot_events(spark)
    got = session_numbers(df, "id", "us", ["ed"], 2_000, name="s", bucket_us=40_000)
    w = Window.partitionBy("id").orderBy("us", "ed")
    lag = F.lag("us").over(w)
    ref = df.withColumn("_n", (lag.isNull() | ((F.col("us") - lag) > 2_000)).cast("long"))
    ref = ref.withColumn("s", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["id", "us", "ed", "s"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())


@pytest.mark.parametrize("key", ["k7_snapshot_j1", "n3_stratified_split", "q3_roc_auc"])
def test_layout_independent(spark, key):
    q = all_queries()[key]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, q(spark, SF_CHECK).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sorted(map(tuple, q(spark, SF_CHECK).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_and_filter_reach_scan(spark):
    p = _plan(all_queries()["a4_read_projection"](spark, SF_CHECK))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


@pytest.mark.parametrize("key", ["k7_snapshot_j2", "l3_static_features", "f1_with_gaps", "k9_prefix_snapshot_j2"])
def test_no_window_over_whole_id_on_events(spark, key):
    """Per-event windows are partitioned by (id, time bucket); a window over the id alone only
    runs on the per-bucket summary rows (bucket totals / bounds / last row)."""
    p = _plan(all_queries()[key](spark, SF_CHECK))
    summary_markers = ("_bkt", "_bmin", "_bmax", "_bs_", "_last")
    for line in p.splitlines():
        if "Window [" in line and "windowspecdefinition(id#" in line:
            assert any(m in line for m in summary_markers), line


def test_snapshot_and_features_on_hot_journey(spark):
    """One journey with a third of all events, spread over many time buckets: the skew-safe
    operators must give the same answer as a direct per-journey computation."""
    import datetime as dt

    from journeyflow.operators import features as fe
    from journeyflow.operators import snapshot as snap
    from journeyflow.schema import event_definitions

    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        jid = "hot" if i % 3 == 0 else f"j{i % 97}"
        rows.append((jid, t0 + dt.timedelta(seconds=rnd.randrange(0, 90 * 86400)), rnd.choice([4, 5, 6, 11, 12, 24, 28 if i % 500 == 0 else 2])))
    df = spark.createDataFrame(rows, "id string, event_timestamp timestamp, ed_id int")
    s = {r.id: r for r in snap.snapshot(df, event_definitions(spark)).collect()}
    w = Window.partitionBy("id").orderBy("event_timestamp", "ed_id")
    # direct reference for the hot journey: number of events up to its cutoff
    cut = s["hot"].cutoff_time
    n_direct = df.where((F.col("id") == "hot") & (F.col("event_timestamp").cast("timestamp_ntz") <= F.lit(cut))).count()
    assert s["hot"].n_events_observed == n_direct
    st = {r.id: r for r in fe.static_features(df).collect()}
    gaps = df.withColumn("_g", (F.unix_micros("event_timestamp") - F.lag(F.unix_micros("event_timestamp")).over(w)))
    mx = gaps.where("id = 'hot'").agg(F.max("_g")).first()[0] // 1_000_000
    assert st["hot"].log1p_max_gap_seconds == pytest.approx(__import__("math").log1p(mx))


def test_exact_percentiles_match_spark(spark):
    from journeyflow.operators.quantiles import exact_percentiles

    rnd = random.Random(11)
    rows = [(i % 4, float(rnd.randrange(0, 40)) if i % 5 else rnd.random() * 500) for i in range(4001)]
    df = spark.createDataFrame(rows, "g int, x double")
    ps = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_percentiles(df, "x", ps, bounds=63).first()
    ref = df.agg(*[F.percentile("x", p).alias(f"p{int(round(p * 100))}") for p in ps]).first()
    assert got.asDict() == pytest.approx(ref.asDict())
    g = {r.g: r.m for r in exact_percentiles(df, "x", [0.5], ["m"], group=["g"], bounds=15).collect()}
    rg = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert g == pytest.approx(rg)


def test_hot_id_inside_one_hour(spark):
    """Half of the rows are one id's, all inside an hour: they spread over buckets and equal the plain window."""
    from pyspark.sql import Window

    from journeyflow.operators.ordered import BOUNDS, _with_bucket, ordered_scan, session_numbers

    rnd = random.Random(9)
    hour = 3_600_000_000
    rows = [("hot", rnd.randrange(hour), rnd.randrange(3)) for _ in range(20000)] + [(f"i{k % 700}", rnd.randrange(10**13), rnd.randrange(30)) for k in range(20000)]
    rows += [("hot", None, 1), (None, 5, 2), (None, 7, 2)] + [("same", 10, 1)] * 50
    df = spark.createDataFrame(rows, "id string, us long, ed int")
    cut = _with_bucket(df, ["id"], "us", None)
    sizes = {(r.id, r._bkt): r["count"] for r in cut.groupBy("id", "_bkt").count().collect()}
    assert max(sizes.values()) < 0.012 * len(rows) and sum(k[0] == "hot" for k in sizes) > BOUNDS // 3
    assert len(sizes) < 750 + BOUNDS  # small ids are not cut
    w = Window.partitionBy("id").orderBy("us", "ed")
    got = ordered_scan(df, "id", "us", ["ed"], prev=["us"], index="step", running={"cum": F.col("ed")}, key_bounds=True)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("id")
    want = df.select("*", F.lag("us").over(w).alias("prev_us"), F.sum("ed").over(up).alias("cum"), F.row_number().over(w).cast("long").alias("step"),
                     F.min("us").over(own).alias("key_first"), F.max("us").over(own).alias("key_last")).select(got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    lag = F.lag("us").over(w)
    starts = df.where("us is not null").withColumn("_s", F.when(lag.isNull() | (F.col("us") - lag > 2_000_000), 1).otherwise(0))
    want = starts.select("id", "us", "ed", F.sum("_s").over(up).alias("session"))
    got = session_numbers(df.where("us is not null"), "id", "us", ["ed"], 2_000_000).select("id", "us", "ed", "session")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_chunked_journeys_round_trip(spark):
    """An id with a third of all rows becomes many bounded arrays, and back the same rows."""
    import datetime as dt

    from journeyflow.operators.clean import nest_chunks, unnest_journeys

    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"j{i % 211}", t0 + dt.timedelta(seconds=rnd.randrange(4000)), rnd.choice([4, 5, 6])) for i in range(9000)]
    df = spark.createDataFrame(rows, "id string, event_timestamp timestamp, ed_id int")
    n = nest_chunks(df, 100).cache()
    assert n.where("size(journey) > 100").count() == 0 and n.where("id = 'hot'").count() == 30
    assert n.where("id = 'hot' and size(journey) = 100 and n_before = chunk * 100").count() == 30
    back = unnest_journeys(n).select(*df.columns)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    # in order inside and across chunks
    ends = n.select("id", "chunk", F.col("journey")[0].alias("a"), F.element_at("journey", -1).alias("b"), (F.array_sort("journey") == F.col("journey")).alias("sorted"))
    nxt = ends.select("id", (F.col("chunk") - 1).alias("chunk"), F.col("a").alias("c"))
    assert ends.where("not sorted").count() == 0 and ends.join(nxt, ["id", "chunk"]).where("b > c").count() == 0


def test_percentiles_of_a_half_equal_column(spark):
    """Half of all rows share a value: it is one counted row, ranges stay even, and no job runs while the plan is built."""
    from journeyflow.operators.ordered import with_position
    from journeyflow.operators.quantiles import column_percentiles, exact_percentiles, value_counts

    rnd = random.Random(5)
    rows = [(7.0 if i % 2 else rnd.random() * 100, None if i % 3 else float("nan") if i % 7 == 0 else float(i % 50), None if i % 4 else "g") for i in range(20000)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    counted = value_counts(df, ["x", "y"])
    assert counted.where("_x = 7.0 and column_name = 'x'").first()._n == 10000 and counted.count() < 10060
    edges = counted.orderBy(F.xxhash64("column_name", "_x")).limit(255).agg(F.sort_array(F.collect_list("_x")).alias("b"))
    sizes = [r["count"] for r in with_position(counted.crossJoin(edges), "b", F.col("_x"), 255, "r").groupBy("r").count().collect()]
    assert max(sizes) <= 0.04 * sum(sizes)
    sc = spark.sparkContext
    sc.setJobGroup("plan", "percentiles are planned without a job")
    ps = [0.1, 0.5, 0.9]
    plan = column_percentiles(df, ["x", "y"], ps)
    assert not sc.statusTracker().getJobIdsForGroup("plan")
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = {r.column_name: (r.p10, r.p50, r.p90) for r in plan.collect()}
    for c in ("x", "y"):
        ref = df.where(~F.isnan(c)).agg(*[F.percentile(c, p) for p in ps]).first()
        assert got[c] == pytest.approx(tuple(ref))
    g = {r.g: r.m for r in exact_percentiles(df, "x", [0.5], ["m"], group=["g"]).collect()}
    assert g == pytest.approx({r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()})
    none = exact_percentiles(df.limit(0), "x", [0.5]).collect()
    assert len(none) == 1 and none[0].p50 is None and exact_percentiles(df.limit(0), "x", [0.5], group=["g"]).count() == 0


def test_top_values_high_cardinality(spark):
    from journeyflow.operators.stats import top_values

    rows = [(f"v{i % 1000}", "a" if i % 3 else None) for i in range(9000)]
    rows += [("v7", "b")] * 5
    df = spark.createDataFrame(rows, "c1 string, c2 string")
    top = {(r.column_name, r.rank): (r.value, r.n) for r in top_values(df, ["c1", "c2"], 3).collect()}
    assert top[("c1", 1)] == ("v7", 14)
    assert top[("c2", 1)] == ("a", 6000) and top[("c2", 2)] == ("MISSING", 3000)


def test_ordered_scan_keeps_null_keys_and_times(spark):
    rows = [("a", 5, 1), ("a", None, 2), (None, 3, 1), (None, 9, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "id string, us long, ed int")
    got = ordered_scan(df, "id", "us", ["ed"], prev=["us"], index="step", bucket_us=4)
    w = Window.partitionBy("id").orderBy("us", "ed")
    ref = df.select("*", F.lag("us").over(w).alias("prev_us"), F.row_number().over(w).alias("step"))
    cols = ["id", "us", "ed", "prev_us", "step"]
    assert sorted(got.select(cols).collect(), key=str) == sorted(ref.select(cols).collect(), key=str)
