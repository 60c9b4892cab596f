"""Windowed counts on streams, with built-in operators only. The same functions work on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.insights import is_label, safe_div


def once(events: DataFrame, delay: str = "1 hour", key: str = "transaction_id") -> DataFrame:
    """Drop repeated ids that arrive within the watermark delay of each other."""
    return events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark([key])


def verdict_windows(scored: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by verdict and the fraud rate per time window, when the window is closed."""
    window = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    counted = scored.withWatermark("event_ts", delay).groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_label("FRAUD")).alias("fraud"), F.count_if(is_label("SUSPICIOUS")).alias("suspicious"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "fraud", "suspicious",
                          F.round(safe_div(F.col("fraud"), F.col("total")), 6).alias("fraud_rate"))


def agreement_counters(scored: DataFrame, champion: Column, challenger: Column) -> DataFrame:
    """Running agreement of two verdicts; use complete mode."""
    return scored.groupBy().agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(champion == challenger).alias("agree"), F.count_if(challenger).alias("challenger_fraud"),
        F.count_if(champion).alias("live_fraud"))


def busy_windows(events: DataFrame, key: str = "entity_id", width: str = "60 seconds", limit: int = 100, delay: str = "1 minute") -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling window."""
    counted = events.withWatermark("event_ts", delay).groupBy(key, F.window("event_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.where(F.col("events") > limit).select(key, F.col("w.start").alias("window_start"), "events")


def activity_sessions(events: DataFrame, gap: str = "1 hour", key: str = "entity_id", delay: str = "1 hour") -> DataFrame:
    """Sessions per key that end after a silence of ``gap``."""
    grouped = events.withWatermark("event_ts", delay).groupBy(key, F.session_window("event_ts", gap).alias("s"))
    counted = grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("amount").alias("amount"))
    return counted.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events",
                          F.round("amount", 4).alias("amount"))
