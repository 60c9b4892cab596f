"""The live job: events -> feature state -> score, rules, watchlist -> alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.contracts import DEFAULT_THRESHOLD
from riskloom.operators.decisions import decide, heuristic_score
from riskloom.streaming import events as stream
from riskloom.streaming import keyed
from riskloom.streaming.state import live_features


def scored(events: DataFrame, rules, watchlist: DataFrame | None = None, threshold: float = DEFAULT_THRESHOLD,
           delay: str = "1 hour", model=None) -> DataFrame:
    """Decisions on live features. Counters are the burst counters, as the live store keeps them.

    ``model`` is a function that adds ``risk_score``; the heuristic is used without one.
    """
    features = live_features(events, delay).withColumns({
        "tx_count_5m": F.col("burst_count_5m"), "tx_count_1h": F.col("burst_count_1h"), "tx_count_24h": F.col("burst_count_24h"),
        "sum_amount_1h": F.col("burst_sum_1h")})
    with_score = model(features) if model else features.withColumn(
        "risk_score", heuristic_score(F.col("device_shift"), F.col("amount")))
    return decide(with_score, rules, watchlist, threshold)


def alert_rows(decided: DataFrame) -> DataFrame:
    features = F.struct("tx_count_5m", "tx_count_1h", "tx_count_24h", "sum_amount_1h", "device_shift")
    return decided.select(
        F.col("transaction_id").alias("id"), F.col("event_ts").alias("created_at"), "transaction_id", "entity_id", "risk_score",
        "risk_label", F.to_json(features).alias("feature_json"), "rules_triggered", F.lit("open").alias("status"))


def run(events: DataFrame, rules, watchlist: DataFrame | None, alert_path: str, delay: str = "1 hour", model=None, buckets: int = 64, **options):
    """Start the stream. Each transaction id appears once in the alert table (read with ``keyed.read``), also when it comes again
    in another trigger or a trigger is retried; an event sent again does not reach the features either."""
    decided = scored(events, rules, watchlist, delay=delay, model=model)
    write = keyed.upsert(alert_path, "id", buckets=buckets)
    return stream.start(decided, lambda batch, epoch: write(alert_rows(batch), epoch), **options)


def run_messages(messages: DataFrame, rules, watchlist: DataFrame | None, alert_path: str, **options):
    """As ``run``, from raw messages (``value``, ``arrived_at``); messages without an entity or amount are left out."""
    return run(stream.for_features(stream.parse(messages)), rules, watchlist, alert_path, **options)
