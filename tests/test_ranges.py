"""Ranks of whole ids in balanced ranges, correlation with NULLs, exact absorption, wide sums."""

import pytest
from pyspark.sql import functions as F

from journeyflow.operators import models as md
from journeyflow.operators import prep
from journeyflow.operators import sampling as sm
from journeyflow.operators import stats as st


def test_rank_of_ids_with_a_common_prefix(spark):
    ids = spark.range(60_000).select(F.format_string("customer_with_prefix_%09d", F.col("id")).alias("id"), (F.col("id") + 1).alias("want"))
    got = sm.rank_distinct(ids, "id", "r")
    assert got.where("r != want").count() == 0 and got.count() == 60_000


def test_ranges_are_balanced(spark, monkeypatch):
    seen = []
    real = sm.ordered_scan

    def look(df, *args, **kw):
        seen.append(df.groupBy("_range").count().agg(F.max("count")).first()[0])
        return real(df, *args, **kw)

    monkeypatch.setattr(sm, "ordered_scan", look)
    ids = spark.range(60_000).select(F.format_string("customer_with_prefix_%09d", F.col("id")).alias("id"))
    sm.rank_distinct(ids, "id", "r")
    assert seen[0] < 0.02 * 60_000


@pytest.mark.parametrize("n", [0, 1, 40])
def test_rank_of_few_values(spark, n):
    got = sm.rank_distinct(spark.range(n).select((F.col("id") * -3).alias("id")), "id", "r").orderBy("r").collect()
    assert [r.id for r in got] == sorted(-3 * k for k in range(n)) and [r.r for r in got] == list(range(1, n + 1))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_found_by_binary_search(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("id"))
    assert "filter(_bounds" not in _plan(sm.rank_distinct(ids, "id", "r"))  # looks at every bound for every value


def test_id_split_moves_no_rows(spark):
    d = spark.range(1000).select((F.col("id") % 90).cast("string").alias("id"), "id").toDF("id", "t")
    plan = sm.id_split(d, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("train", [0.0, 0.37, 0.8, 1.0])
@pytest.mark.parametrize("n, null", [(0, False), (0, True), (1, False), (5, False), (4, True), (9, True), (5000, True)])
def test_id_split_counts_null_as_the_last_id(spark, train, n, null):
    ids = [f"user_{k:05d}" for k in range(n)]
    d = spark.range(2 * n + null).select(F.format_string("user_%05d", (F.col("id") / 2).cast("long")).alias("id"), F.col("id").alias("t"))
    d = d.withColumn("id", F.when(F.col("t") < 2 * n, F.col("id")))
    got = sm.id_split(d, train).collect()
    limit = int((n + null) * train)
    assert sorted((r.t, r.id, r.split) for r in got) == [(2 * i + j, v, "train" if i < limit else "valid") for i, v in enumerate(ids) for j in (0, 1)]


def test_codes_of_numbers_and_nulls(spark):
    d = spark.createDataFrame([(5.0,), (None,), (1.5,), (5.0,)], "x double")
    assert sorted((r.x or 0, r.x_code) for r in prep.index_categories(d, ["x"]).collect()) == [(0, 0), (1.5, 1), (5.0, 2), (5.0, 2)]


def test_correlation_uses_complete_pairs(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (900.0, None), (None, -70.0)], "a double, b double")
    got = {(r.a, r.b): r["corr"] for r in st.corr_matrix(d, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0)


def test_absorption_of_a_slow_stage_is_complete(spark):
    m = spark.createDataFrame([("s", "s", 0.999), ("s", "success", 0.00075), ("s", "ended", 0.00025), ("stuck", "stuck", 1.0),
                               ("success", "success", 1.0), ("ended", "ended", 1.0)], "from_stage string, to_stage string, prob double")
    got = {(r.from_stage, r.absorbed_in): r.probability for r in md.absorption(m).collect()}
    assert got["s", "success"] == pytest.approx(0.75) and got["s", "ended"] == pytest.approx(0.25)
    assert got["stuck", "success"] == 0.0 and got["ended", "ended"] == 1.0 and got["ended", "success"] == 0.0


def test_exposure_beyond_a_long(spark):
    us = 5 * 10**18  # two of them are more than a long holds
    st = spark.createDataFrame([("a", "success", us), ("a", "unsuccessful", us), ("a", "ongoing", us), ("b", "success", 86_400_000_000)],
                               "segment string, status string, active_us long")
    got = {r.segment: r for r in md.markov_transitions(st, "segment").collect()}
    assert got["a"].exposure_days == 3 * us / 86400e6 and got["a"].rate_success == 1 / (3 * us / 86400e6)
    assert got["a"].p_absorb_success == pytest.approx(0.5)
    assert (got["b"].n_journeys, got["b"].exposure_days) == (1, 1.0)
