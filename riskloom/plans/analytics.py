"""The analytics pack over an alert table: one DataFrame per result."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from riskloom.operators import insights, ranking


def pack(alerts: DataFrame, feedback: DataFrame, as_of: datetime.datetime | None = None) -> dict[str, DataFrame]:
    as_of = as_of or insights.newest(alerts)
    features = ["tx_count_1h", "sum_amount_1h", "tx_count_24h"]
    return {
        "summary": insights.summary(alerts, as_of), "series": insights.daily_series(alerts, as_of),
        "impact": insights.impact(alerts, as_of), "countries": insights.by_country(alerts, as_of),
        "monitor": insights.monitor(alerts, as_of), "top_entities": insights.top_entities(alerts),
        "feedback": insights.feedback_stats(feedback), "profiles": insights.entity_profiles(alerts),
        "drift": insights.psi(ranking.halves(alerts, "created_at", "id"), features),
    }
