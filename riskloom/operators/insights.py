"""Analytics over the alert table. ``as_of`` stands in for the current time; money is ``sum_amount_1h``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.contracts import LATENCY_BUCKETS, REVIEW_COST, SECONDS_30D
from riskloom.functions.scalar import country
from riskloom.operators.features import velocity
from riskloom.operators.ordered import HOT_ROWS
from riskloom.operators.ranking import top_per_key


def newest(alerts: DataFrame) -> datetime.datetime:
    return alerts.agg(F.max("created_at").alias("t")).first().t


def since(as_of: datetime.datetime, **span) -> Column:
    return F.col("created_at") >= F.lit(as_of - datetime.timedelta(**span))


def is_label(label: str) -> Column:
    return F.col("risk_label") == label


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def verdict_totals(alerts: DataFrame) -> DataFrame:
    """Counts by verdict, the fraud rate in percent, and open cases: all of the table's time."""
    row = alerts.agg(
        F.count(F.lit(1)).alias("transactions"), *[F.count_if(is_label(v)).alias(v.lower()) for v in ("FRAUD", "SUSPICIOUS", "SAFE")],
        F.count_if((F.col("status") == "open") & ~is_label("SAFE")).alias("open_cases"))
    return row.withColumn("fraud_rate", F.round(safe_div(F.col("fraud"), F.col("transactions")) * 100, 2))


def daily_series(alerts: DataFrame, as_of: datetime.datetime, days: int = 14) -> DataFrame:
    recent = alerts.where(since(as_of, days=days))
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        *[F.count_if(is_label(v)).alias(v.lower()) for v in ("SAFE", "SUSPICIOUS", "FRAUD")],
        F.round(F.coalesce(F.sum(F.when(is_label("FRAUD"), F.col("sum_amount_1h"))), F.lit(0.0)), 4).alias("blocked"))


def summary(alerts: DataFrame, as_of: datetime.datetime, days: int = 14, window_totals: bool = False) -> DataFrame:
    """Totals with the amount blocked. Label totals are all-time unless ``window_totals``."""
    inside = since(as_of, days=days)
    blocked = F.coalesce(F.sum(F.when(is_label("FRAUD") & inside, F.col("sum_amount_1h"))), F.lit(0.0))
    counted = inside if window_totals else F.lit(True)
    row = alerts.agg(
        F.count_if(counted).alias("transactions"), F.count_if(is_label("FRAUD") & counted).alias("fraud"),
        F.count_if((F.col("status") == "open") & ~is_label("SAFE")).alias("open_cases"), F.round(blocked, 2).alias("amount_blocked"))
    return row.withColumn("fraud_rate", F.round(safe_div(F.col("fraud"), F.col("transactions")) * 100, 2))


def impact(alerts: DataFrame, as_of: datetime.datetime, days: int = 30, review_cost: float = REVIEW_COST) -> DataFrame:
    """Value caught, open exposure, review cost of suspicious alerts, and the net of the two."""
    amount = lambda label: F.coalesce(F.sum(F.when(is_label(label), F.col("sum_amount_1h"))), F.lit(0.0))
    row = alerts.where(since(as_of, days=days)).agg(
        amount("FRAUD").alias("caught"), amount("SUSPICIOUS").alias("exposed"),
        F.count_if(is_label("FRAUD")).alias("fraud_count"), F.count_if(is_label("SUSPICIOUS")).alias("suspicious_count"))
    cost = F.round(F.col("suspicious_count") * review_cost, 2)
    return row.select(
        F.round("caught", 2).alias("value_caught"), F.round("exposed", 2).alias("exposure_open"), cost.alias("fp_review_cost"),
        F.round(F.col("caught") - cost, 2).alias("net_protected"), "fraud_count", "suspicious_count")


def by_country(alerts: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """Totals per pseudo-country. Alerts are first counted per entity, so each entity is hashed once."""
    per_entity = alerts.where(since(as_of, days=days)).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_label("FRAUD")).alias("fraud"))
    located = per_entity.select(country(F.col("entity_id")).alias("c"), "total", "fraud")
    counted = located.groupBy(F.col("c.code").alias("code"), F.col("c.country").alias("country")).agg(
        F.sum("total").alias("total"), F.sum("fraud").alias("fraud"))
    return counted.withColumn("fraud_rate", F.round(safe_div(F.col("fraud"), F.col("total")) * 100, 1)).orderBy(F.desc("fraud"), "code")


def fraud_rate(alerts: DataFrame, as_of: datetime.datetime, hours: int) -> DataFrame:
    row = alerts.where(since(as_of, hours=hours)).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_label("FRAUD")).alias("fraud"))
    return row.withColumn("rate", F.round(safe_div(F.col("fraud"), F.col("total")), 6))


def monitor_status(recent_total: Column, recent_rate: Column, base_total: Column, base_rate: Column) -> Column:
    ratio = safe_div(recent_rate, base_rate)
    return (F.when((recent_total < 5) | (base_total < 20), "insufficient")
            .when((ratio >= 1.75) & (recent_rate > 0.1), "spike").when(ratio >= 1.25, "elevated").otherwise("normal"))


def monitor(alerts: DataFrame, as_of: datetime.datetime, recent_hours: int = 1, base_hours: int = 24) -> DataFrame:
    """The last hours against the trailing baseline (which contains them), in one pass."""
    recent = since(as_of, hours=recent_hours)
    row = alerts.where(since(as_of, hours=base_hours)).agg(
        F.count_if(recent).alias("recent_total"), F.count_if(recent & is_label("FRAUD")).alias("recent_fraud"),
        F.count(F.lit(1)).alias("baseline_total"), F.count_if(is_label("FRAUD")).alias("baseline_fraud"))
    r, b = safe_div(F.col("recent_fraud"), F.col("recent_total")), safe_div(F.col("baseline_fraud"), F.col("baseline_total"))
    return row.withColumns({
        "status": monitor_status(F.col("recent_total"), r, F.col("baseline_total"), b),
        "recent_rate": F.round(r * 100, 2), "baseline_rate": F.round(b * 100, 2), "ratio": F.round(safe_div(r, b), 2)})


def entity_profiles(alerts: DataFrame, rows: int = 500) -> DataFrame:
    """Profile of every entity over its newest ``rows`` alerts."""
    recent = top_per_key(alerts, ["entity_id"], [F.desc("created_at"), F.desc("id")], rows)
    latest = F.max_by("sum_amount_1h", F.struct("created_at", "id"))
    out = recent.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("transactions"), *[F.count_if(is_label(v)).alias(v.lower()) for v in ("FRAUD", "SUSPICIOUS", "SAFE")],
        F.count_if(F.col("device_shift") == 1).alias("device_shifts"), F.avg("sum_amount_1h").alias("_mean"),
        F.stddev_pop("sum_amount_1h").alias("_std"), F.avg("tx_count_1h").alias("_velocity"), F.avg("risk_score").alias("_risk"),
        latest.alias("_latest"))
    z = F.when(F.col("_std") > 0, (F.col("_latest") - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    return out.select(
        "entity_id", country(F.col("entity_id"))["code"].alias("country_code"), "transactions", "fraud", "suspicious", "safe",
        "device_shifts", F.round("_mean", 2).alias("avg_amount"), F.round("_std", 2).alias("std_amount"),
        F.round("_velocity", 1).alias("avg_velocity_1h"), F.round("_risk", 3).alias("avg_risk"),
        F.round("_latest", 2).alias("latest_amount"), F.round(z, 2).alias("latest_amount_z"))


def top_entities(alerts: DataFrame, k: int = 8) -> DataFrame:
    flagged = alerts.where(~is_label("SAFE")).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("flags"), F.round(F.max("risk_score"), 3).alias("max_score"))
    return flagged.orderBy(F.desc("flags"), "entity_id").limit(k)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """All dispositions, repeated ones included."""
    row = feedback.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "confirmed_fraud").alias("confirmed_fraud"),
        F.count_if(F.col("label") == "false_positive").alias("false_positive"))
    labelled = F.nullif(F.col("confirmed_fraud") + F.col("false_positive"), F.lit(0))
    return row.withColumn("labelled_precision", F.round(F.col("confirmed_fraud") / labelled, 3))


def recent_feedback(feedback: DataFrame, k: int = 12) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(k).select("id", "alert_id", "label", "analyst")


def latency_histogram(scored: DataFrame, latency: str = "latency_s", bounds=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound and per verdict, with an unbounded last bucket."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(latency) <= b).alias("count")) for b in bounds]
    counts.append(F.struct(F.lit("+Inf").alias("le"), F.count(F.lit(1)).alias("count")))
    return scored.groupBy("risk_label").agg(F.array(*counts).alias("buckets")).select("risk_label", F.inline("buckets"))


def key_skew(tx: DataFrame, key: str = "account_id", window: int = SECONDS_30D, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """How unevenly rows spread over keys, and the fullest window of any key."""
    sizes = tx.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.agg(F.count(F.lit(1)).alias("n_keys"), F.percentile("n", F.lit(0.5)).alias("median_rows"),
                       F.percentile("n", F.lit(0.99)).alias("p99_rows"), F.max("n").alias("max_rows"))
    fullest = velocity(tx, {"_in_window": window}, hot_rows=hot_rows).agg(F.max("_in_window").alias("max_rows_in_window")).first()[0]
    return spread.withColumn("max_rows_in_window", F.lit(fullest))


def sla(alerts: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Age class of open, non-safe alerts: overdue after 4 hours, ageing after 1."""
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("created_at")
    pending = alerts.where(~is_label("SAFE") & ~F.col("status").isin("resolved", "dismissed"))
    return pending.withColumn("sla", F.when(age > 4 * 3600, "overdue").when(age > 3600, "ageing").otherwise("on time"))


def search(alerts: DataFrame, text: str = "", label: str | None = None) -> DataFrame:
    """Verdict filter and case-insensitive substring search over entity and transaction id."""
    rows = alerts.where(is_label(label)) if label else alerts
    if not text.strip():
        return rows
    haystack = F.lower(F.concat_ws(" ", F.col("entity_id"), F.col("transaction_id").cast("string")))
    return rows.where(haystack.contains(text.strip().lower()))


def page(alerts: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first."""
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def page_after(alerts: DataFrame, created_at, identifier, limit: int = 50) -> DataFrame:
    """The page that follows a given row: a filter instead of an ever larger offset."""
    later = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("id") < identifier))
    return page(alerts.where(later), 0, limit)


def live_feed(alerts: DataFrame, k: int = 50) -> DataFrame:
    """The newest ``k`` alerts, each id once."""
    once = top_per_key(alerts, ["id"], [F.desc("created_at")], 1)
    return once.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def unseen(page_rows: DataFrame, feed: DataFrame) -> DataFrame:
    """The feed, and those rows of a page that it does not hold yet."""
    return feed.unionByName(page_rows.join(feed.select("id"), "id", "left_anti"))


def psi(df: DataFrame, features: list[str], half: str = "half", bins: int = 10) -> DataFrame:
    """Population stability of ``recent`` against ``base`` rows, for all features in two passes.

    Ten equal-width bins over both halves, shares floored at 1e-6, 0 when a half has fewer than 20 values.
    """
    ranges = df.agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features]).first()
    long = df.select(half, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([half], features, "feature", "value")
    long = long.where(F.col("value").isNotNull())
    lo = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(float(ranges[f].lo or 0)))])
    hi = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(float(ranges[f].hi or 0)))])
    low, high = lo[F.col("feature")], hi[F.col("feature")]
    position = F.when(high > low, (F.col("value") - low) / (high - low) * bins).otherwise(F.lit(0.0))
    counts = long.withColumn("bin", F.least(F.greatest(F.floor(position), F.lit(0)), F.lit(bins - 1))).groupBy("feature", "bin").agg(
        F.count_if(F.col(half) == "base").alias("b"), F.count_if(F.col(half) == "recent").alias("r"))
    # features x bins rows at most: counts per feature ride along as a window over that small table
    per = Window.partitionBy("feature")
    shares = counts.withColumns({"nb": F.sum("b").over(per), "nr": F.sum("r").over(per)})
    floor = lambda n, total: F.greatest(n / F.greatest(total, F.lit(1)), F.lit(1e-6))
    term = (floor(F.col("r"), F.col("nr")) - floor(F.col("b"), F.col("nb"))) * F.log(
        floor(F.col("r"), F.col("nr")) / floor(F.col("b"), F.col("nb")))
    out = shares.groupBy("feature").agg(F.sum(term).alias("_psi"), F.max("nb").alias("nb"), F.max("nr").alias("nr"))
    n = F.col("nb") + F.col("nr")
    value = F.when((n < 60) | (F.col("nb") < 20) | (F.col("nr") < 20), F.lit(0.0)).otherwise(F.round("_psi", 4))
    status = F.when(n < 60, "insufficient").when(value < 0.1, "stable").when(value < 0.25, "warning").otherwise("drift")
    return out.select("feature", value.alias("psi"), status.alias("status"), n.alias("n"))
