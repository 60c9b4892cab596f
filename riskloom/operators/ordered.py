"""Running aggregates over an ordered key that stay balanced when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a key into one task. That is the right plan for ordinary keys, and a
wrong one for a key with a third of the table. ``split_hot`` separates the two, and ``slice_ordered`` +
``running`` compute the hot part: rows are range-partitioned on (key, order), so slices are balanced whatever the
keys are; each slice aggregates locally, and the totals of the earlier slices of the same key are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

HOT_ROWS = 20_000      # a sliding frame costs up to rows^2 / 2 per key, so plain windows stop here
MAX_HOT_KEYS = 10_000  # above this many hot keys everything takes the sliced path
SLICE = "_slice"


def split_hot(df: DataFrame, key: str, hot_rows: int | None = HOT_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """Split ``df`` into rows of ordinary keys and rows of hot keys (``None`` where a side is empty).

    One map-side-combined count over the key column decides. At most ``MAX_HOT_KEYS + 1`` keys reach the driver.
    """
    if hot_rows is None:
        return df, None
    counts = df.groupBy(key).count().where(F.col("count") > hot_rows)
    hot = [row[0] for row in counts.select(key).limit(MAX_HOT_KEYS + 1).collect()]
    if not hot:
        return df, None
    if len(hot) > MAX_HOT_KEYS:
        return None, df
    keys = df.sparkSession.createDataFrame([(k,) for k in hot], df.select(key).schema)
    marked = null_safe_left(df, F.broadcast(keys.withColumn("_hot", F.lit(True))), [key])
    return marked.where(F.col("_hot").isNull()).drop("_hot"), marked.where(F.col("_hot")).drop("_hot")


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which null meets null, as in a window's partitions."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match &= left[k].eqNullSafe(other[f"_right_{k}"])
    return left.join(other, match, "left").drop(*[f"_right_{k}" for k in keys])


def by_heat(df: DataFrame, key: str, plain, sliced, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Apply ``plain`` to ordinary keys, ``sliced`` to hot ones, and put the results together."""
    ordinary, hot = split_hot(df, key, hot_rows)
    if hot is None:
        return plain(ordinary)
    if ordinary is None:
        return sliced(hot)
    return plain(ordinary).unionByName(sliced(hot))


def slice_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def slice_ordered(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Tag every row with the number of its range slice on (keys, order).

    The slice number comes from sampled range bounds, so the result is written out before it is used twice.
    """
    ranged = df.repartitionByRange(slices or slice_count(df), *keys, *order)
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id()))


def _merge_moments(acc: Column, x: Column) -> Column:
    n = acc["n"] + x["n"]
    delta = x["mean"] - acc["mean"]
    share = F.when(n > 0, x["n"] / n).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n"),
        (acc["mean"] + delta * share).alias("mean"),
        (acc["m2"] + x["m2"] + delta * delta * acc["n"] * share).alias("m2"),
    )


def running(df: DataFrame, keys: list[str], order: list[str], spec: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates up to and including the current row of each key in ``order``.

    ``spec`` maps an output name to (kind, column); kinds are ``sum``, ``count``, ``max``, ``lag`` and ``moments``
    (a struct n, mean, m2). With a slice column the totals of earlier slices are carried in; without one these are
    plain windows. A null key is a key of its own, as in a plain window.
    """
    sliced = SLICE in df.columns
    part = ([SLICE] if sliced else []) + keys
    ordered = Window.partitionBy(*part).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    for name, (kind, col) in spec.items():
        if kind == "sum":
            local[name] = F.sum(col).over(upto)
        elif kind == "count":
            local[name] = F.count(col).over(upto)
        elif kind == "max":
            local[name] = F.max(col).over(upto)
        elif kind == "lag":
            local[name] = F.lag(F.struct(col.alias("v"))).over(ordered)
        elif kind == "moments":
            n = F.count(col).over(upto)
            local[name] = F.struct(n.cast("double").alias("n"), F.coalesce(F.avg(col).over(upto), F.lit(0.0)).alias("mean"),
                                   F.coalesce(F.var_pop(col).over(upto) * n, F.lit(0.0)).alias("m2"))
        else:
            raise ValueError(kind)
    out = df.withColumns(local)
    if sliced:
        carry = _carry(df, keys, order, spec)
        out = null_safe_left(out, F.broadcast(carry), [SLICE, *keys])
    final = {}
    for name, (kind, _) in spec.items():
        here, before = F.col(name), F.col(f"_carry_{name}")
        if kind == "lag":
            final[name] = (F.coalesce(here, before) if sliced else here)["v"]
        elif sliced and kind in ("sum", "count"):
            final[name] = F.when(before.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + before)
        elif sliced and kind == "max":
            final[name] = F.greatest(here, before)
        elif sliced and kind == "moments":
            final[name] = F.when(before.isNull(), here).otherwise(_merge_moments(before, here))
    out = out.withColumns(final)
    return out.drop(*[f"_carry_{name}" for name in spec]) if sliced else out


def _carry(df: DataFrame, keys: list[str], order: list[str], spec: dict) -> DataFrame:
    """State of each key at the start of a slice that continues it.

    Range slices are contiguous, so a slice continues at most one key: the result has fewer rows than there are
    slices, which is what allows broadcasting it.
    """
    aggs, carried = [], {}
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, col) in spec.items():
        total = f"_carry_{name}"
        if kind in ("sum", "count", "max"):
            aggs.append(getattr(F, kind)(col).alias(total))
            carried[total] = getattr(F, "max" if kind == "max" else "sum")(total).over(before)
        elif kind == "lag":
            aggs.append(F.max_by(F.struct(col.alias("v")), F.struct(*order)).alias(total))
            carried[total] = F.lag(total).over(Window.partitionBy(*keys).orderBy(SLICE))
        else:
            n = F.count(col)
            aggs.append(F.struct(n.cast("double").alias("n"), F.coalesce(F.avg(col), F.lit(0.0)).alias("mean"),
                                 F.coalesce(F.var_pop(col) * n, F.lit(0.0)).alias("m2")).alias(total))
            zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
            carried[total] = F.aggregate(F.collect_list(total).over(before), zero, _merge_moments)
    totals = df.groupBy(SLICE, *keys).agg(*aggs)
    first = F.min(SLICE).over(Window.partitionBy(*keys))
    return totals.withColumns({**carried, "_first": first}).where(F.col(SLICE) > F.col("_first")).drop("_first")


def kth_key(df: DataFrame, order: list[Column], k: int) -> tuple | None:
    """The ordering key of the ``k``-th row (1-based) of the whole table, without a one-partition sort.

    Only the ordering columns are sliced. Slice sizes find the slice, and one bounded slice is ranked.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keyed = slice_ordered(df.select(*[c.alias(n) for c, n in zip(order, names)]), [], names)
    if k < 1:
        return None
    for slice_id, size in sorted((r[0], r[1]) for r in keyed.groupBy(SLICE).count().collect()):
        if k <= size:
            ranked = keyed.where(F.col(SLICE) == slice_id).withColumn(
                "_rank", F.row_number().over(Window.partitionBy(SLICE).orderBy(*names)))
            row = ranked.where(F.col("_rank") == k).first()
            return tuple(row[n] for n in names)
        k -= size
    return None


def at_most(order: list[Column], bound: tuple | None) -> Column:
    """True for rows whose ordering key is at or before ``bound``."""
    if bound is None:
        return F.lit(False)
    result = F.lit(True)
    for col, value in reversed(list(zip(order, bound))):
        # nulls come first, as in the sort that found the bound
        below = F.coalesce(col < F.lit(value), col.isNull()) if value is not None else F.lit(False)
        result = below | (col.eqNullSafe(F.lit(value)) & result)
    return result
