"""Literal edge frames (FIXTURES.md section 4) through the core operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from journeyflow.operators import features as fe
from journeyflow.operators import metrics as mt
from journeyflow.operators import snapshot as snap
from journeyflow.operators import stats as st
from journeyflow.operators.sequences import pad_sequences
from journeyflow.schema import event_definitions

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ev(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), e) for i, s, e in rows]
    return spark.createDataFrame(data, "id string, event_timestamp timestamp, ed_id int")


def snap1(spark, rows):
    return {r["id"]: r for r in snap.snapshot(ev(spark, rows), event_definitions(spark)).collect()}


def test_one_event_only(spark):
    s = snap1(spark, [("a", 0, 4)])
    r = s["a"]
    assert r.n_events_observed == 1 and r.label_order_shipped == 0
    assert r.sampling_weight_days == 60 and r.journey_terminal_reason == "inactive_60d"


def test_success_first_is_flagged_leak(spark):
    r = snap1(spark, [("a", 0, 28), ("a", 10, 4)])["a"]
    assert r.label_order_shipped == 1 and r.leaked_success is True
    assert r.cutoff_time == T0 and r.n_events_observed == 1


def test_success_twice_uses_first(spark):
    t = {r.id: r for r in snap.terminal(ev(spark, [("a", 0, 4), ("a", 100, 28), ("a", 200, 28)])).collect()}
    assert t["a"].journey_terminal_time == T0 + dt.timedelta(seconds=100)


def test_equal_timestamps_order_by_event(spark):
    f = {r.id: r for r in st.first_last(ev(spark, [("a", 5, 11), ("a", 5, 4), ("a", 9, 6), ("a", 9, 2)]), event_definitions(spark)).collect()}
    assert f["a"].first_ed_id == 4 and f["a"].last_ed_id == 6


def test_event_without_definition_keeps_row(spark):
    r = snap1(spark, [("a", 0, 24)])["a"]
    assert r.first_event_name is None and r.max_milestone_seen is None


def test_gap_exactly_60_days_status(spark):
    day = 86400
    s = {r.id: r.status for r in snap.journey_status(ev(spark, [("a", 0, 4), ("b", 60 * day, 4)])).collect()}
    assert s["a"] == "unsuccessful" and s["b"] == "ongoing"


def test_all_gaps_zero(spark):
    x = fe.static_features(ev(spark, [("a", 0, 5), ("a", 0, 6), ("a", 0, 7)])).first()
    assert x.zero_gap_share == 1.0 and x.events_last_5h == 3.0 and x.log1p_total_elapsed_seconds == 0.0


@pytest.mark.parametrize("n", [128, 129])
def test_sequence_boundary(spark, n):
    rows = [("a", i, 4) for i in range(n)]
    r = pad_sequences(ev(spark, rows), 128, keep="last").first()
    assert len(r.event_arr) == 128 and r.n_real == 128 and sum(r.mask_arr) == 128


def test_empty_prefix_gets_zero_vector(spark):
    e = ev(spark, [("a", 0, 28), ("b", 0, 4), ("b", 5, 5)])
    ids = e.select("id").distinct()
    out = {r.id: r for r in fe.static_features(snap.open_prefix(e), ids=ids).collect()}
    assert all(v == 0.0 for k, v in out["a"].asDict().items() if k != "id")
    assert out["b"].log1p_journey_length > 0


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0)], "p double, y int")
    assert mt.roc_auc(df).first().roc_auc is None


def test_tied_scores_auc_half(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 1), (0.5, 0)], "p double, y int")
    assert mt.roc_auc(df).first().roc_auc == pytest.approx(0.5)


def test_log_loss_clips_p0_p1(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0)], "p double, y int")
    v = mt.log_loss(df, eps=1e-6).first().log_loss
    assert v == pytest.approx(-__import__("math").log(1e-6))


def test_constant_feature_scaler(spark):
    from journeyflow.operators.prep import apply_scaler, fit_scaler

    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    st_ = fit_scaler(df, ["x"], floor=1e-6)
    assert st_.first().x_std == 1.0
    assert [r.x for r in apply_scaler(df, fit_scaler(df, ["x"]), ["x"]).collect()] == [0.0, 0.0]


def test_series_shorter_than_window(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, d), float(d)) for d in range(1, 11)], "series string, date timestamp_ntz, y double")
    assert all(r.trend is None for r in st.centered_mean(df, 365).collect())


def test_blend_weights_sum_to_one(spark):
    df = spark.createDataFrame([("a", "1", 1, 0.9), ("b", "1", 1, 0.6), ("a", "2", 0, 0.2), ("b", "2", 0, 0.5)],
                               "model string, id string, y int, p double")
    w = mt.blend_weights(df).agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(1.0)


def test_shapley_linear_sums_to_margin_difference(spark):
    from journeyflow.operators.explain import shapley_linear

    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 0.0), ("c", 2.0, 1.0)], "id string, x1 double, x2 double")
    long, _ = shapley_linear(df, 0.5, {"x1": 2.0, "x2": -1.0})
    tot = {r.id: r.s for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    # z(x) - z(mean x), mean = (2, 1)
    assert tot["a"] == pytest.approx(2.0 * (1 - 2) - 1.0 * (2 - 1))
