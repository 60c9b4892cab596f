"""Published literals, boundaries and ties of the behavioural features."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features

SCHEMA = ("account_id string, transaction_id long, event_time_seconds double, amount double, device_id string, merchant_id string")
AMOUNTS = [12.0, 40.0, 41.0, 9.0, 500.0, 22.0, 23.0, 24.0, 7.0, 1000.0]


def rows(spark, times, amounts=None, devices=None, merchants=None):
    n = len(times)
    data = [("a", i, float(t), float((amounts or [1.0] * n)[i]), (devices or ["d"] * n)[i], (merchants or ["m"] * n)[i])
            for i, t in enumerate(times)]
    return spark.createDataFrame(data, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("transaction_id").collect()]


def test_zscore_is_the_running_sample_score(spark):
    found = column(features.amount_zscore(rows(spark, range(10), AMOUNTS)), "amount_zscore")
    assert found[0] == 0
    for i in range(1, 10):
        seen = AMOUNTS[:i + 1]
        assert math.isclose(found[i], (AMOUNTS[i] - statistics.mean(seen)) / statistics.stdev(seen), abs_tol=1e-9)
    assert math.isclose(abs(found[1]), 1 / math.sqrt(2), abs_tol=1e-9)


def test_equal_amounts_have_score_zero(spark):
    assert column(features.amount_zscore(rows(spark, range(3), [5, 5, 5])), "amount_zscore") == [0, 0, 0]


def test_device_shift(spark):
    devices = ["ios:iphone", "ios:iphone", "android:pixel", "android:pixel", "desktop:win"]
    assert column(features.device_shift(rows(spark, range(5), devices=devices)), "device_shift") == [0, 0, 1, 0, 1]


def test_window_counts(spark):
    found = features.velocity(rows(spark, [0, 60, 120, 200, 4000, 4100, 90000]))
    assert column(found, "tx_count_5m") == [1, 2, 3, 4, 1, 2, 1]


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_boundaries_and_ties(spark, hot_rows):
    tied = rows(spark, [0, 0, 300, 300, 600])
    closed = features.velocity(tied, {"c": 300}, hot_rows=hot_rows)
    half_open = features.velocity(tied, {"c": 300}, "left_open", hot_rows=hot_rows)
    assert column(closed, "c") == [2, 2, 4, 4, 3]
    assert column(half_open, "c") == [1, 2, 1, 2, 1]


def test_burst_counter_is_not_a_sliding_window(spark):
    steady = rows(spark, [0, 200, 400, 600, 1000])
    assert column(features.bursts(steady), "burst_count_5m") == [1, 2, 3, 4, 1]
    assert column(features.velocity(steady), "tx_count_5m") == [1, 2, 2, 2, 1]


def test_shift_modes_differ(spark):
    df = rows(spark, [0, 10, 20, 5000, 5010], devices=["a", "b", "b", "c", "c"])
    assert column(features.device_shift(df), "device_shift") == [0, 1, 0, 1, 0]
    assert column(features.device_shift(df, "lag_within"), "device_shift") == [0, 1, 0, 0, 0]
    assert column(features.device_shift(df, "sticky"), "device_shift") == [0, 1, 1, 1, 1]


def test_distinct_merchants_has_a_floor(spark):
    df = rows(spark, [0, 10, 3600, 3601], merchants=["x", "y", "x", None])
    assert column(features.distinct_merchants(df), "unique_merchants_1h") == [1, 2, 2, 2]
    assert column(features.distinct_merchants(rows(spark, [0], merchants=[None])), "unique_merchants_1h") == [1]


def test_category_presence_may_be_zero(spark):
    df = rows(spark, [0, 10], devices=["q", "q"])
    assert column(features.category_presence(df, ["w", "h"]), "category_count_1h") == [0, 0]


def test_calendar_reference_epoch(spark):
    df = rows(spark, [0, 86400 * 2]).withColumn("event_ts", F.timestamp_seconds("event_time_seconds"))
    assert column(features.calendar(df, "2017-11-30"), "is_weekend") == [0, 1]
