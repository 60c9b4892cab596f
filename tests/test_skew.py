"""The sliced path for hot keys must agree with plain windows, ties included."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskloom.functions.exact import ExactSum, Grid
from riskloom.operators import features, ordered, ranking

PATHS = {
    "closed": lambda d, h: features.velocity(d, {"c5": 5, "c20": 20}, hot_rows=h),
    "left_open": lambda d, h: features.velocity(d, {"c5": 5, "c20": 20}, "left_open", hot_rows=h),
    "amount": lambda d, h: features.amount_1h(d, 20, hot_rows=h),
    "amount_left_open": lambda d, h: features.amount_1h(d, 20, "left_open", hot_rows=h),
    "merchants": lambda d, h: features.distinct_merchants(d, 20, hot_rows=h),
    "merchants_left_open": lambda d, h: features.distinct_merchants(d, 20, "left_open", hot_rows=h),
    "categories": lambda d, h: features.category_presence(d, ["d0", "d1"], window=20, hot_rows=h),
    "lag": lambda d, h: features.device_shift(d, hot_rows=h),
    "lag_within": lambda d, h: features.device_shift(d, "lag_within", within=2, hot_rows=h),
    "sticky": lambda d, h: features.device_shift(d, "sticky", within=3, memory=4, hot_rows=h),
    "expanding": lambda d, h: features.amount_zscore(d, hot_rows=h),
    "rolling": lambda d, h: features.amount_zscore(d, "rolling_30d", 30, hot_rows=h),
    "gap_reset": lambda d, h: features.amount_zscore(d, "gap_reset_30d", 3, hot_rows=h),
    "bursts": lambda d, h: features.bursts(d, {"b2": 2, "b4": 4}, 3, hot_rows=h),
    "behaviour": lambda d, h: features.behaviour(d, hot_rows=h),
}


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows, two thirds of them on one account, many at equal times."""
    rows = spark.range(600).select(
        F.col("id").alias("transaction_id"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 40).cast("string"))).alias("account_id"),
        F.floor(F.pmod(F.xxhash64("id"), F.lit(700))).cast("double").alias("event_time_seconds"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)) / 100).alias("amount"),
        F.concat(F.lit("d"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)).cast("string")).alias("device_id"),
        F.concat(F.lit("m"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6)).cast("string")).alias("merchant_id"))
    return rows.cache()


def collected(df):
    return [tuple(r) for r in df.select(*sorted(df.columns)).orderBy("transaction_id").collect()]


def same(left, right):
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y


@pytest.mark.parametrize("name", PATHS)
@pytest.mark.parametrize("hot_rows", [100, 0])
def test_sliced_equals_plain(skewed, name, hot_rows):
    plain, mixed = PATHS[name](skewed, None), PATHS[name](skewed, hot_rows)
    assert sorted(plain.columns) == sorted(mixed.columns)
    same(collected(plain), collected(mixed))


@pytest.mark.parametrize("name", ["amount", "amount_left_open", "expanding", "rolling", "gap_reset"])
def test_odd_amounts_are_the_same_on_both_paths(skewed, name):
    """NaN and infinite amounts show in every window that holds them, and in no other."""
    odd = F.when(F.col("transaction_id") % 97 == 5, F.lit(float("nan"))).when(F.col("transaction_id") % 89 == 7, F.lit(math.inf))
    rows = skewed.withColumn("amount", odd.when(F.col("transaction_id") % 83 == 9, F.lit(-math.inf)).otherwise(F.col("amount")))
    plain, sliced = collected(PATHS[name](rows, None)), collected(PATHS[name](rows, 0))
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(x) and math.isnan(y))
    for a, b in zip(plain, sliced, strict=True):
        assert all(close(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b))
    if name.startswith("amount"):
        at = sorted(PATHS[name](rows, 0).columns).index("sum_amount_1h")
        brute = {}
        base = rows.collect()
        for r in base:
            t = r.event_time_seconds
            inside = (lambda x: t - 20 <= x.event_time_seconds <= t) if name == "amount" else (
                lambda x: t - 20 < x.event_time_seconds <= t and (x.event_time_seconds < t or x.transaction_id <= r.transaction_id))
            brute[r.transaction_id] = sum(x.amount for x in base if x.account_id == r.account_id and inside(x))
        want = [brute[i] for i in sorted(brute)]
        assert all(close(a, b[at]) for a, b in zip(want, sliced))


@pytest.mark.parametrize("name", ["amount", "amount_left_open", "rolling"])
@pytest.mark.parametrize("kind", ["cents", "far apart", "odd"])
def test_window_sums_are_equal_to_the_last_bit(skewed, name, kind):
    """The size of an account changes no bit of a sum or a rolling z-score; sums are the exact ones."""
    i = F.col("transaction_id")
    amount = {"cents": F.col("amount"), "odd": F.when(i % 97 == 5, math.nan).when(i % 89 == 7, math.inf).when(i % 5 == 0, F.lit(None)).otherwise(F.col("amount")),
              "far apart": F.when(i % 5 == 0, 1e19).when(i % 5 == 1, -1e19).when(i % 5 == 2, 3e-11).when(i % 5 == 3, -F.col("amount")).otherwise(F.col("amount"))}[kind]
    rows = skewed.withColumn("amount", amount.cast("double"))
    plain, sliced = collected(PATHS[name](rows, None)), collected(PATHS[name](rows, 0))
    assert repr(plain) == repr(sliced)
    if name == "amount" and kind == "far apart":
        base = rows.collect()
        at = sorted(PATHS[name](rows, 0).columns).index("sum_amount_1h")
        for r, found in zip(sorted(base, key=lambda r: r.transaction_id), sliced):
            inside = (x.amount for x in base if x.account_id == r.account_id and r.event_time_seconds - 20 <= x.event_time_seconds <= r.event_time_seconds)
            assert found[at] == float(sum(map(Fraction, inside)))


@pytest.mark.parametrize("values", [[0.1, -0.3, 2.0 ** 60 + 256, 12.34], [1e300, -1e300, 1e284, 1e270], [5e-324, -5e-324, 1e-310, 2.5e-308], [0.0, -0.0], [1e19, 3e-11, -1e19]])
def test_exact_sums_round_once(spark, values):
    rows = [(g, values[(g * 7 + k) % len(values)]) for g in range(20) for k in range(g + 1)] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    total = ExactSum(Grid.covering(df, F.col("x")), "x")
    sums = df.withColumns(total.given(F.col("x"))).groupBy("g").agg(*[F.sum(c).alias(c) for c in total.columns])
    found = sums.withColumn("v", total.value()).withColumn("rest", total.left_over(F.col("v")))
    for r in found.collect():
        exact = sum(Fraction(x) for g, x in rows if g == r.g and x is not None)
        assert (r.v, r.rest) == ((float(exact), float(exact - Fraction(float(exact)))) if r.g != 99 else (None, 0.0))


def test_too_many_hot_keys_take_the_sliced_path(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_HOT_KEYS", 3)
    ordinary, hot = ordered.split_hot(skewed, "account_id", 0)
    assert ordinary is None and hot.count() == 600


@pytest.mark.parametrize("k", [1, 2, 299, 300, 600])
def test_kth_key(skewed, k):
    expected = sorted((r.event_time_seconds, r.transaction_id) for r in skewed.collect())[k - 1]
    assert ordered.kth_key(skewed, [F.col("event_time_seconds"), F.col("transaction_id")], k) == expected
    assert ordered.kth_key(skewed, [F.col("transaction_id")], 0) is None


def test_stratified_split_keeps_class_shares(skewed):
    out = ranking.stratified_split(skewed.withColumn("y", (F.col("transaction_id") % 10 == 0).cast("int")), "y", "transaction_id")
    counts = {(r.y, r.part): r["count"] for r in out.groupBy("y", "part").count().collect()}
    assert counts == {(0, "train"): 432, (0, "validation"): 108, (1, "train"): 48, (1, "validation"): 12}


def test_null_accounts_and_times_survive_the_sliced_path(spark):
    """Rows with a null account or time get the same answer from both paths."""
    rows = [(i, None if i % 5 == 0 else "a", None if i % 7 == 3 else 100 * (i // 3), float(i)) for i in range(60)]
    tx = spark.createDataFrame(rows, "transaction_id long, account_id string, event_time_seconds long, amount double")
    both = lambda h: features.velocity(features.amount_1h(tx, 400, hot_rows=h), {"c": 300}, hot_rows=h)
    plain, sliced = both(None), both(0)
    order = lambda df: sorted((tuple(r) for r in df.select(*plain.columns).collect()), key=repr)
    assert order(plain) == order(sliced)
