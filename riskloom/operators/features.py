"""Behavioural features per account.

Input: ``account_id, transaction_id, event_time_seconds, amount, device_id, merchant_id``. Range frames follow
``event_time_seconds``; row frames are ordered by (event_time_seconds, transaction_id). Every function keeps all
input columns and rows. Ordinary accounts use one window shuffle; accounts above ``hot_rows`` rows take the sliced
path of :mod:`riskloom.operators.ordered`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.contracts import SECONDS_1H, SECONDS_24H, SECONDS_30D, SECONDS_5M, SHIFT_MEMORY, SHIFT_STICKY
from riskloom.functions.exact import ExactSum, Grid, finite, product
from riskloom.operators.ordered import HOT_ROWS, SLICE, by_heat, null_safe_left, running, slice_ordered

KEY, TIME, ID = "account_id", "event_time_seconds", "transaction_id"
ORDER = [TIME, ID]
COUNT_WINDOWS = {"tx_count_5m": SECONDS_5M, "tx_count_1h": SECONDS_1H, "tx_count_24h": SECONDS_24H}


def _range(low: int, high: int = 0):
    return Window.partitionBy(KEY).orderBy(TIME).rangeBetween(low, high)


def _ratio(total: Column, count: Column) -> Column:
    return total / F.greatest(count, F.lit(1))


# ---------------------------------------------------------------- sliding counts, sums and distinct merchants

def velocity(tx: DataFrame, windows: dict[str, int] | None = None, boundary: str = "closed",
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Transactions in the trailing window: ``closed`` = [t-w, t] with all rows at t; ``left_open`` = (t-w, t]
    without rows at t that have a later id."""
    windows = windows or COUNT_WINDOWS
    one = F.lit(1)

    def plain(df):
        if boundary == "closed":
            return df.withColumns({n: F.count(one).over(_range(-w)) for n, w in windows.items()})
        peers = Window.partitionBy(KEY, TIME)
        later = F.count(one).over(peers) - F.row_number().over(peers.orderBy(ID))
        return df.withColumns({
            n: F.count(one).over(_range(-w)) - F.count(one).over(_range(-w, -w)) - later for n, w in windows.items()})

    def sliced(df):
        return _sliced_windows(df, {n: ("count", w) for n, w in windows.items()}, boundary)

    return by_heat(tx, KEY, plain, sliced, hot_rows)


def _total(column: str) -> str:
    return f"{column}_total"


def amount_1h(tx: DataFrame, window: int = SECONDS_1H, boundary: str = "closed",
              hot_rows: int | None = HOT_ROWS, amounts: ExactSum | None = None) -> DataFrame:
    """``sum_amount_1h`` and ``avg_amount_1h`` over the trailing window. The sum is the exact one, rounded once."""
    amounts = amounts or _amounts(tx)

    def plain(df):
        count, frame = F.count(F.lit(1)).over(_range(-window)), _range(-window)
        inside = lambda value: F.sum(value).over(frame)
        if boundary == "left_open":
            peers = Window.partitionBy(KEY, TIME)
            upto = peers.orderBy(ID).rowsBetween(Window.unboundedPreceding, 0)

            def inside(value):
                late = F.sum(value).over(peers) - F.sum(value).over(upto)
                return F.sum(value).over(frame) - F.coalesce(F.sum(value).over(_range(-window, -window)), F.lit(0)) - late

            count = (count - F.count(F.lit(1)).over(_range(-window, -window))
                     - F.count(F.lit(1)).over(peers) + F.row_number().over(peers.orderBy(ID)))
        out = df.withColumns(amounts.given(F.col("amount")))
        out = out.withColumns({_total(c): inside(F.col(c)) for c in amounts.columns} | {"_n": count})
        return _summed(out, amounts)

    def sliced(df):
        measures = {_total(c): ("total", window, c) for c in amounts.columns} | {"_n": ("count", window)}
        return _summed(_sliced_windows(df.withColumns(amounts.given(F.col("amount"))), measures, boundary), amounts)

    return by_heat(tx, KEY, plain, sliced, hot_rows)


def _amounts(tx: DataFrame) -> ExactSum:
    return ExactSum(Grid.covering(tx, F.col("amount")), "amount")


def _summed(df: DataFrame, amounts: ExactSum) -> DataFrame:
    """Sum and mean from the totals, which go."""
    out = df.withColumn("sum_amount_1h", amounts.value(lambda c: F.col(_total(c))))
    out = out.withColumn("avg_amount_1h", _ratio(F.col("sum_amount_1h"), F.col("_n")))
    return out.drop("_n", *amounts.columns, *map(_total, amounts.columns))


def distinct_merchants(tx: DataFrame, window: int = SECONDS_1H, boundary: str = "closed",
                       hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Distinct merchants in the trailing window, at least 1. ``left_open`` is what the live sorted set holds."""
    low = -window if boundary == "closed" else -(window - 1)

    def plain(df):
        seen = F.size(F.collect_set("merchant_id").over(_range(low)))
        return df.withColumn("unique_merchants_1h", F.greatest(seen, F.lit(1)))

    def sliced(df):
        out = _sliced_windows(df, {"_seen": ("distinct", window)}, boundary, exclude_later_ties=False)
        return out.withColumn("unique_merchants_1h", F.greatest(F.col("_seen").cast("int"), F.lit(1))).drop("_seen")

    return by_heat(tx, KEY, plain, sliced, hot_rows)


def _sliced_windows(tx: DataFrame, measures: dict[str, tuple], boundary: str, exclude_later_ties: bool = True) -> DataFrame:
    """Sliding windows as a running sum of arrivals minus expiries.

    A row adds itself at t and removes itself when the window has passed. Arrivals are pre-aggregated per
    (account, second), so the width of this stream follows elapsed time, not the row count of the account. ``measures`` are
    ("count", window), ("distinct", window) or ("total", window, a column of longs); all are exact.
    """
    expiry = 2 if boundary == "closed" else 0  # arrivals are phase 1
    given = sorted({m[2] for m in measures.values() if m[0] == "total"})
    base = tx.groupBy(KEY, TIME).agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in given])
    zero, column = F.lit(0).cast("long"), {n: m[2] if m[0] == "total" else m[0] for n, m in measures.items()}

    def delta(at: Column, phase: int, values: dict[str, Column]) -> Column:
        return F.struct(at.alias("at"), F.lit(phase).alias("phase"),
                        *[values.get(n, zero).cast("long").alias(n) for n in measures])

    steps = [delta(F.col(TIME), 1, {n: F.col(c) for n, c in column.items() if c != "distinct"})]
    for w in sorted({m[1] for m in measures.values()}):
        leaving = {n: -F.col(c) for n, c in column.items() if c != "distinct" and measures[n][1] == w}
        steps += [delta(F.col(TIME) + w, expiry, leaving)] if leaving else []
    stream = base.select(KEY, F.inline(F.array(*steps)))
    for name, (kind, w, *_) in measures.items():
        if kind == "distinct":
            stream = stream.unionByName(_presence(tx, name, w, boundary, delta))
    stream = stream.groupBy(KEY, "at", "phase").agg(*[F.sum(n).alias(n) for n in measures])
    totals = running(slice_ordered(stream, [KEY], ["at", "phase"]), [KEY], ["at", "phase"],
                     {n: ("sum", F.col(n)) for n in measures}).where(F.col("phase") == 1)
    out = null_safe_left(tx, totals.select(KEY, F.col("at").alias(TIME), *measures), [KEY, TIME])
    return _drop_later_ties(out, column) if boundary == "left_open" and exclude_later_ties else out


def _presence(tx: DataFrame, name: str, w: int, boundary: str, delta) -> DataFrame:
    """+1 while a merchant is inside the window; overlapping visits cancel the earlier expiry."""
    expiry = 2 if boundary == "closed" else 0
    visits = tx.where(F.col("merchant_id").isNotNull()).select(KEY, "merchant_id", TIME).distinct()
    visits = running(slice_ordered(visits, [KEY, "merchant_id"], [TIME]), [KEY, "merchant_id"], [TIME],
                     {"_before": ("lag", F.col(TIME))})
    end, one = F.col("_before") + w, F.lit(1)
    overlaps = F.coalesce(F.col(TIME) <= end if expiry == 2 else F.col(TIME) < end, F.lit(False))
    opened = F.array(delta(F.col(TIME), 1, {name: one}), delta(F.col(TIME) + w, expiry, {name: -one}))
    extended = F.array(delta(end, expiry, {name: one}), delta(F.col(TIME) + w, expiry, {name: -one}))
    return visits.select(KEY, F.inline(F.when(overlaps, extended).otherwise(opened)))


def _drop_later_ties(df: DataFrame, column: dict[str, str]) -> DataFrame:
    """Takes from each measure what the rows at the same time with a later id give it."""
    value = {c: F.lit(1) if c == "count" else F.col(c) for c in column.values() if c != "distinct"}
    peers = df.groupBy(KEY, TIME).agg(*[F.sum(v).alias(f"_peer_{c}") for c, v in value.items()])
    upto = running(slice_ordered(df, [KEY, TIME], [ID]), [KEY, TIME], [ID], {f"_upto_{c}": ("sum", v) for c, v in value.items()}).drop(SLICE)
    out = null_safe_left(upto, peers, [KEY, TIME])
    out = out.withColumns({n: F.col(n) - (F.col(f"_peer_{c}") - F.col(f"_upto_{c}")) for n, c in column.items() if c in value})
    return out.drop(*[f"_{side}_{c}" for side in ("peer", "upto") for c in value])


def category_presence(tx: DataFrame, categories: list[str], column: str = "device_id", window: int = SECONDS_1H,
                      hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """How many of the fixed ``categories`` occur in (t-w, t], leaving out later ties; 0 is possible."""
    flags = {f"_is_{i}": F.when(F.col(column) == c, F.lit(1)).otherwise(F.lit(0)) for i, c in enumerate(categories)}
    total = sum((F.col(f) for f in flags), F.lit(0))

    def plain(df):
        peers = Window.partitionBy(KEY, TIME).orderBy(ID).rowsBetween(Window.unboundedPreceding, 0)
        earlier = {f: F.coalesce(F.max(c).over(_range(-(window - 1), -1)), F.lit(0)) for f, c in flags.items()}
        here = {f: F.max(c).over(peers) for f, c in flags.items()}
        return df.withColumns({f: F.greatest(earlier[f], here[f]) for f in flags})

    def sliced(df):
        seen = running(slice_ordered(df, [KEY], ORDER), [KEY], ORDER, {
            f: ("max", F.when(c == 1, F.col(TIME))) for f, c in flags.items()}).drop(SLICE)
        return seen.withColumns({
            f: F.when(F.col(f) > F.col(TIME) - window, F.lit(1)).otherwise(F.lit(0)) for f in flags})

    out = by_heat(tx, KEY, plain, sliced, hot_rows)
    return out.withColumn("category_count_1h", total).drop(*flags)


# ---------------------------------------------------------------- device shifts

def _sequence(tx: DataFrame, spec: dict, hot_rows: int | None) -> DataFrame:
    return by_heat(
        tx, KEY,
        lambda df: running(df, [KEY], ORDER, spec),
        lambda df: running(slice_ordered(df, [KEY], ORDER), [KEY], ORDER, spec).drop(SLICE),
        hot_rows)


def device_shift(tx: DataFrame, mode: str = "lag", within: int = SHIFT_STICKY, memory: int = SHIFT_MEMORY,
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``device_shift`` as 0/1.

    ``lag``: the previous device differs. ``lag_within``: it differs and at most ``within`` seconds have passed.
    ``sticky``: a change against a device remembered for ``memory`` seconds happened less than ``within`` seconds ago.
    """
    last = {"_device": ("lag", F.coalesce(F.col("device_id"), F.lit(""))), "_time": ("lag", F.col(TIME))}
    current = F.coalesce(F.col("device_id"), F.lit(""))
    gap = F.col(TIME) - F.col("_time")
    differs = F.col("_device").isNotNull() & (F.col("_device") != current)
    if mode == "lag":
        flag = F.col("_device").isNotNull() & F.col("device_id").isNotNull() & (F.col("_device") != "") & differs
    elif mode == "lag_within":
        flag = differs & (gap <= within)
    elif mode == "sticky":
        changed = differs & (F.col("_device") != "") & (gap < memory)

        def steps(df, key_order):
            seen = key_order(df, last)
            return key_order(seen.withColumn("_changed", F.when(changed, F.col(TIME))), {"_shift": ("max", F.col("_changed"))})

        out = by_heat(
            tx, KEY,
            lambda df: steps(df, lambda d, s: running(d, [KEY], ORDER, s)),
            lambda df: steps(slice_ordered(df, [KEY], ORDER), lambda d, s: running(d, [KEY], ORDER, s)).drop(SLICE),
            hot_rows)
        flag = F.coalesce(F.col(TIME) - F.col("_shift") < within, F.lit(False))
        return out.withColumn("device_shift", flag.cast("int")).drop("_device", "_time", "_changed", "_shift")
    else:
        raise ValueError(mode)
    out = _sequence(tx, last, hot_rows)
    return out.withColumn("device_shift", F.coalesce(flag, F.lit(False)).cast("int")).drop("_device", "_time")


# ---------------------------------------------------------------- amount z-score

def _zscore(mean: Column, std: Column) -> Column:
    return F.when(std > 0, (F.col("amount") - mean) / std).otherwise(F.lit(0.0))


def _moments_zscore(moments: Column) -> Column:
    std = F.when(moments["n"] > 1, F.sqrt(moments["m2"] / (moments["n"] - 1)))
    return F.coalesce(_zscore(moments["mean"], std), F.lit(0.0))


def amount_zscore(tx: DataFrame, mode: str = "expanding", window: int = SECONDS_30D,
                  hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Deviation of the amount from the account's own mean in sample standard deviations, 0 when undefined.

    ``expanding``: all rows so far. ``rolling_30d``: rows in [t-window, t]. ``gap_reset_30d``: rows since the last
    silence of at least ``window`` seconds.
    """
    if mode == "expanding":
        def plain(df):
            upto = Window.partitionBy(KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
            return df.withColumn("amount_zscore", _zscore(F.avg("amount").over(upto), F.stddev_samp("amount").over(upto)))

        def sliced(df):
            out = running(slice_ordered(df, [KEY], ORDER), [KEY], ORDER, {"_m": ("moments", F.col("amount"))})
            return out.withColumn("amount_zscore", _moments_zscore(F.col("_m"))).drop("_m", SLICE)

        return by_heat(tx, KEY, plain, sliced, hot_rows)
    if mode == "rolling_30d":
        moments = _rolling_moments(tx)

        def plain(df):
            out = moments.given(df)
            count = {"_n": F.count("amount").over(_range(-window))}
            return moments.zscore(out.withColumns({_total(c): F.sum(c).over(_range(-window)) for c in moments.columns} | count))

        def sliced(df):
            out = moments.given(df).withColumn("_one", F.col("amount").isNotNull().cast("long"))
            measures = {_total(c): ("total", window, c) for c in moments.columns} | {"_n": ("total", window, "_one")}
            return moments.zscore(_sliced_windows(out, measures, "closed").drop("_one"))

        return by_heat(tx, KEY, plain, sliced, hot_rows)
    if mode == "gap_reset_30d":
        out = sessions(tx, window, hot_rows=hot_rows)
        out = _in_session(out, {"_m": ("moments", F.col("amount"))}, hot_rows)
        return out.withColumn("amount_zscore", _moments_zscore(F.col("_m"))).drop("_m", "session_no")
    raise ValueError(mode)


@dataclass(frozen=True)
class RollingMoments:
    """Exact sums of the deviations from a centre and of their squares, and the z-score they give.

    Both sums are kept to twice the digits of a double and subtracted so. Scatter below 2**-96 of what is subtracted is taken as none:
    the amounts of such a window do not differ by more than their own last digits.
    """

    centre: float
    first: ExactSum
    second: ExactSum

    @property
    def columns(self) -> list[str]:
        return self.first.columns + self.second.columns

    def given(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_d", F.col("amount").cast("double") - self.centre)
        odd = ~F.col("_d").isin(math.inf, -math.inf, math.nan)  # of an odd square nothing is left over
        whole, rest = product(F.col("_d"), F.col("_d"))
        out = out.withColumns({"_d2": whole, "_r2": F.when(odd, rest).otherwise(F.lit(0.0))})
        return out.withColumns(self.first.given(F.col("_d")) | self.second.given(F.col("_d2"), F.col("_r2"))).drop("_d", "_d2", "_r2")

    def zscore(self, df: DataFrame) -> DataFrame:
        total = lambda c: F.col(_total(c))
        out = df.withColumns({"_s": self.first.value(total), "_q": self.second.value(total), "_c": F.col("_n").cast("double")})
        out = out.withColumns({"_s1": self.first.left_over(F.col("_s"), total), "_q1": self.second.left_over(F.col("_q"), total)})
        (a, b), (c, d) = product(F.col("_c"), F.col("_q")), product(F.col("_s"), F.col("_s"))
        out = out.withColumns({"_a": a, "_b": b + F.col("_c") * F.col("_q1"), "_e": c, "_f": d + F.lit(2.0) * F.col("_s") * F.col("_s1")})
        scatter = (F.col("_a") - F.col("_e")) + (F.col("_b") - F.col("_f"))
        out = out.withColumn("_v", F.when(scatter > F.col("_a") * F.lit(2.0 ** -96), scatter).when(scatter != scatter, scatter).otherwise(F.lit(0.0)))
        std = F.when(F.col("_n") > 1, F.sqrt(F.col("_v") / F.nullif(F.col("_c") * (F.col("_c") - 1), F.lit(0.0))))
        score = F.coalesce(_zscore(F.col("_s") / F.col("_c") + self.centre, std), F.lit(0.0))
        gone = ["_s", "_q", "_c", "_s1", "_q1", "_a", "_b", "_e", "_f", "_v", "_n"]
        return out.withColumn("amount_zscore", score).drop(*gone, *self.columns, *map(_total, self.columns))


def _rolling_moments(tx: DataFrame) -> RollingMoments:
    amount = finite(F.col("amount"))
    mean = tx.agg(F.avg(amount)).first()[0]
    centre = round(float(mean), 2) if mean is not None and math.isfinite(mean) else 0.0
    deviation = F.col("amount").cast("double") - centre
    return RollingMoments(centre, ExactSum(Grid.covering(tx, deviation), "d1"), ExactSum(Grid.covering(tx, deviation, squares=True), "d2"))


# ---------------------------------------------------------------- gap-based bursts

def sessions(tx: DataFrame, gap: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``session_no`` per account: a new session starts after a silence of at least ``gap`` seconds."""
    def steps(df):
        seen = running(df, [KEY], ORDER, {"_time": ("lag", F.col(TIME))})
        starts = F.when(F.col("_time").isNull() | (F.col(TIME) - F.col("_time") >= gap), 1).otherwise(0)
        return running(seen.withColumn("_start", starts), [KEY], ORDER, {"session_no": ("sum", F.col("_start"))})

    out = by_heat(tx, KEY, steps, lambda df: steps(slice_ordered(df, [KEY], ORDER)).drop(SLICE), hot_rows)
    return out.drop("_time", "_start")


def _in_session(tx: DataFrame, spec: dict, hot_rows: int | None) -> DataFrame:
    keys = [KEY, "session_no"]
    return by_heat(
        tx, KEY,
        lambda df: running(df, keys, ORDER, spec),
        lambda df: running(slice_ordered(df, keys, ORDER), keys, ORDER, spec).drop(SLICE),
        hot_rows)


def bursts(tx: DataFrame, windows: dict[str, int] | None = None, sum_window: int | None = SECONDS_1H,
           hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Counters that reset after a silence of a whole window (what an expiring counter really holds)."""
    windows = windows or {"burst_count_5m": SECONDS_5M, "burst_count_1h": SECONDS_1H, "burst_count_24h": SECONDS_24H}
    sums = {"burst_sum_1h": sum_window} if sum_window else {}

    def steps(df):
        out = running(df, [KEY], ORDER, {"_time": ("lag", F.col(TIME))})
        silence = F.col(TIME) - F.col("_time")
        gaps = sorted({*windows.values(), *sums.values()})
        out = out.withColumns({
            f"_start_{g}": F.when(F.col("_time").isNull() | (silence >= g), 1).otherwise(0) for g in gaps})
        out = running(out, [KEY], ORDER, {f"_session_{g}": ("sum", F.col(f"_start_{g}")) for g in gaps})
        for g in gaps:
            spec = {n: ("count", F.lit(1)) for n, w in windows.items() if w == g}
            spec |= {n: ("sum", F.col("amount")) for n, w in sums.items() if w == g}
            out = running(out, [KEY, f"_session_{g}"], ORDER, spec)
        return out.drop("_time", *[f"_start_{g}" for g in gaps], *[f"_session_{g}" for g in gaps])

    return by_heat(tx, KEY, steps, lambda df: steps(slice_ordered(df, [KEY], ORDER)).drop(SLICE), hot_rows)


# ---------------------------------------------------------------- calendar and bundles

def calendar(tx: DataFrame, reference_epoch: str | None = None) -> DataFrame:
    """Event-time ``hour_of_day`` and ``is_weekend``; with ``reference_epoch`` from the seconds offset instead."""
    ts = F.col("event_ts")
    if reference_epoch:
        base = F.unix_timestamp(F.to_timestamp(F.lit(reference_epoch)))
        ts = F.timestamp_seconds(F.col(TIME) + base)
    weekend = F.dayofweek(ts).isin(1, 7)
    return tx.withColumns({"hour_of_day": F.hour(ts), "is_weekend": weekend.cast("int")})


def behaviour(tx: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """All features of the training contract in their default modes, with one shuffle for ordinary accounts."""
    amounts = _amounts(tx)

    def plain(df):
        df = velocity(df, hot_rows=None)
        df = amount_1h(df, hot_rows=None, amounts=amounts)
        df = distinct_merchants(df, hot_rows=None)
        df = device_shift(df, hot_rows=None)
        return amount_zscore(df, hot_rows=None)

    def sliced(df):
        measures = {n: ("count", w) for n, w in COUNT_WINDOWS.items()}
        measures |= {_total(c): ("total", SECONDS_1H, c) for c in amounts.columns} | {"_seen": ("distinct", SECONDS_1H)}
        df = _sliced_windows(df.withColumns(amounts.given(F.col("amount"))), measures, "closed")
        df = _summed(df.withColumn("_n", F.col("tx_count_1h")), amounts)
        df = df.withColumn("unique_merchants_1h", F.greatest(F.col("_seen").cast("int"), F.lit(1))).drop("_seen")
        device = F.coalesce(F.col("device_id"), F.lit(""))
        df = running(slice_ordered(df, [KEY], ORDER), [KEY], ORDER,
                     {"_device": ("lag", device), "_m": ("moments", F.col("amount"))})
        shifted = (F.col("_device") != "") & F.col("device_id").isNotNull() & (F.col("_device") != device)
        return df.withColumns({
            "device_shift": F.coalesce(shifted, F.lit(False)).cast("int"),
            "amount_zscore": _moments_zscore(F.col("_m"))}).drop("_device", "_m", SLICE)

    return by_heat(tx, KEY, plain, sliced, hot_rows)
