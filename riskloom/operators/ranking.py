"""Latest rows, top-k and splits by rank, without sorting a table or a hot key in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordered import at_most, kth_key


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark applies the limit on each map task first, so a hot key ships k rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_per_key(df, keys, [F.desc(c) for c in order], 1)


def survivors(df: DataFrame, keys: list[str], first_by: list[str]) -> DataFrame:
    """One row per key: the first by ``first_by`` and then by all other columns, so that reruns agree."""
    rest = [c for c in df.columns if c not in keys and c not in first_by]
    return top_per_key(df, keys, [F.asc_nulls_last(c) for c in [*first_by, *rest]], 1)


def chronological_split(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """``part`` = train for the first ``int(n * share)`` rows in ``order``, validation for the rest."""
    cut = kth_key(df, [F.col(c) for c in order], int(df.count() * share))
    early = at_most([F.col(c) for c in order], cut)
    return df.withColumn("part", F.when(early, "train").otherwise("validation"))


def halves(df: DataFrame, time: str, tie: str) -> DataFrame:
    """``half`` = recent for the newest n//2 rows, base for the rest."""
    n = df.count()
    order = [F.unix_micros(F.col(time)), F.col(tie)]
    cut = kth_key(df, order, n - n // 2)
    return df.withColumn("half", F.when(at_most(order, cut), "base").otherwise("recent"))


def stratified_split(df: DataFrame, label: str, identifier: str, share: float = 0.2) -> DataFrame:
    """``part`` = validation for the ``share`` of each class with the smallest hash of the id, train for the rest.

    The number of classes is small; each costs one pass over (hash, id) of that class.
    """
    order = [F.md5(F.col(identifier).cast("string")), F.col(identifier)]
    held_out = F.lit(False)
    for row in df.groupBy(label).count().collect():
        value, n = row[0], row[1]
        same = F.col(label) == F.lit(value)
        cut = kth_key(df.where(same), order, math.floor(n * share))
        held_out = held_out | (same & at_most(order, cut))
    return df.withColumn("part", F.when(held_out, "validation").otherwise("train"))
