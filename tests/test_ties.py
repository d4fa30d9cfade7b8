"""Means at a threshold."""

import itertools

from pyspark.sql import functions as F

from chronovec.functions import scalar
from chronovec.operators import telemetry
from chronovec.plans import catalog


def test_mean_at_a_threshold_in_any_order(spark):
    """The mean of ten times 0.1 and of their mixtures is 0.1, however the rows are dealt."""
    values = [0.1] * 6 + [0.3, 0.7, 29.27, 1e6 + 0.01, -1e6 - 0.01, -29.27, -0.7, -0.3]
    for k, order in enumerate(itertools.islice(itertools.permutations(values[6:]), 0, 40320, 8000)):
        df = spark.createDataFrame([(x,) for x in [*order, *values[:6]]], "x double").repartition(1 + k % 3)
        assert df.agg(scalar.exact_mean(F.col("x")) * len(values)).first()[0] == 0.6


def test_mean_of_values_that_are_no_short_decimals(spark):
    mean = lambda *v: spark.createDataFrame([(x,) for x in v], "x double").agg(scalar.exact_mean(F.col("x"))).first()[0]
    assert mean(1e-20, 3e-20) == (1e-20 + 3e-20) / 2 and mean(1e300, 1e300) == 1e300 and mean(float("inf"), 1.0) == float("inf")
    assert mean(None, 2.0, 4.0) == 3.0 and mean(None) is None and mean(1 / 3) == 1 / 3


def test_labels_and_actions_at_a_threshold(spark, tmp_path):
    """Values of a mean of just 50, whose double sum is below 50 times their number in this order."""
    values = [77.11, 64.85, 8.04]
    assert (values[0] + values[1]) + values[2] < 150 and sum(round(100 * v) for v in values) == 15000
    df = spark.createDataFrame([(1, v) for v in values], "u long, v double").coalesce(1)
    assert telemetry.load_summary(df, ["u"], "v", 50, 110).first()["status"] == "good"
    rows = [(k, f"2024-01-01 00:00:0{k}", 1, "view", v) for k, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    # under 20 frames a second at a load of 50, which is not under 50
    assert sorted(r.action for r in catalog.QUERIES["j13_tuning_actions"](spark, str(tmp_path)).collect()) == ["batch_size:increase", "cuda_streams:increase"]
