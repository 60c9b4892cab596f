"""How much each feature contributed to a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the fallback attribution.
WEIGHTS = {"tx_count_5m": 0.05, "tx_count_1h": 0.01, "tx_count_24h": -0.002, "avg_amount_1h": 0.00015}
SHIFT, NO_SHIFT = 0.35, -0.05


def heuristic(with_amount: bool = True) -> Column:
    """Map feature -> contribution where no model explains the score."""
    names = [n for n in WEIGHTS if with_amount or n != "avg_amount_1h"]
    pairs = [x for n in names for x in (F.lit(n), F.round(F.col(n) * WEIGHTS[n], 4))]
    shift = F.when(F.col("device_shift") == 1, F.lit(SHIFT)).otherwise(F.lit(NO_SHIFT))
    return F.create_map(*pairs, F.lit("device_shift"), shift)


def strongest(contributions: Column, k: int = 8) -> Column:
    """The ``k`` largest contributions by absolute value, as an array of (feature, value)."""
    keyed = F.transform(F.map_entries(contributions), lambda e: F.struct(
        (-F.abs(e["value"])).alias("order"), e["key"].alias("feature"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))
