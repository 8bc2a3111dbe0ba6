"""Sampling invariants (N1-N10): exact counts, class shares, no journey split across sides."""

import math

import pytest
from pyspark.sql import functions as F

from journeyflow.operators import sampling as sm


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"id{i:05d}", 1 if i % 7 == 0 else 0, (i * 37 % 101) / 101.0) for i in range(3000)]
    return spark.createDataFrame(rows, "id string, y int, p double")


def _counts(df, col="y"):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_stratified_split_exact_per_class(labelled):
    s = sm.stratified_split(labelled, "y", 0.2, 42)
    sizes = _counts(labelled)
    valid = _counts(s.where("split = 'valid'"))
    assert all(valid[k] == math.ceil(0.2 * n) for k, n in sizes.items())


def test_folds_balanced(labelled):
    f = sm.stratified_folds(labelled, "y", 5, 42)
    per = f.groupBy("fold", "y").count().collect()
    by_class = {}
    for r in per:
        by_class.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_class.values())


def test_resample_rate(labelled):
    r = sm.resample_to_rate(labelled, "y", 0.05, 42)
    c = _counts(r)
    assert c[0] == _counts(labelled)[0]
    assert c[1] == max(1, math.floor(c[0] * 0.05 / 0.95))


def test_stratified_cap_total(labelled):
    assert sm.stratified_cap(labelled, 500, "y", 42).count() == 500
    assert sm.stratified_cap(labelled, 10_000, "y", 42).count() == 3000


def test_balanced_validation(labelled):
    c = _counts(sm.balanced_validation(labelled, 400, 0.05, "y", 42))
    assert c == {1: 20, 0: 380}


def test_id_split_never_splits_a_journey(spark):
    rows = [(f"u{i % 250:03d}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, t int")
    s = sm.id_split(df, 0.8)
    sides = s.groupBy("id").agg(F.countDistinct("split").alias("k"), F.first("split").alias("split"))
    assert sides.where("k > 1").count() == 0
    train_ids = sorted(r.id for r in sides.where("split = 'train'").collect())
    assert train_ids == sorted(f"u{i:03d}" for i in range(250))[:200]


def test_sample_n_and_fraction_layout_independent(spark, labelled):
    a = sorted(r.id for r in sm.sample_n(labelled.repartition(1), 50, 7).collect())
    b = sorted(r.id for r in sm.sample_n(labelled.repartition(9), 50, 7).collect())
    assert a == b and len(a) == 50
    fa = sorted(r.id for r in sm.sample_fraction(labelled.repartition(2), 0.1, 3).collect())
    fb = sorted(r.id for r in sm.sample_fraction(labelled.repartition(7), 0.1, 3).collect())
    assert fa == fb
