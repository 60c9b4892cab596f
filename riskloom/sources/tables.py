"""The test tables as transactions, alerts and case data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.contracts import DEFAULT_THRESHOLD
from riskloom.operators import features
from riskloom.session import pin_utc

FAST_CLOCK_START = 1704067200  # 2024-01-01 UTC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def utc(column: str) -> Column:
    """The tables store times without a zone; they are UTC."""
    return F.col(column).cast("timestamp")


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def as_transactions(events: DataFrame, clock: str = "fast") -> DataFrame:
    """Events as clean transactions. The fast clock reads minutes as seconds, so that velocities are visible."""
    micros = F.unix_micros(utc("ts"))
    if clock == "fast":
        seconds = F.floor((micros - FAST_CLOCK_START * 1_000_000) / 60_000_000)
    else:
        seconds = F.floor(micros / 1_000_000)
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("event_type").alias("device_id"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("merchant_id"),
        F.col("value").alias("amount"),
        seconds.cast("double").alias("event_time_seconds"),
        utc("ts").alias("event_ts"),
        ((F.col("event_type") == "error") & (F.col("value") > 60)).cast("int").alias("is_fraud"),
    )


def transactions(spark: SparkSession, folder: str, clock: str = "fast") -> DataFrame:
    return as_transactions(table(spark, folder, "events"), clock)


def fixed_score(identifier: Column) -> Column:
    """A deterministic score in [0, 1) per id, for operators that only need some score."""
    return (identifier * 7919 % 1000) / 1000


def verdict(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(score >= threshold, "FRAUD").when(score >= threshold * 0.5, "SUSPICIOUS").otherwise("SAFE")


def plain_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts without window features, for operators that never look at them: no shuffle."""
    tx = transactions(spark, folder)
    score = fixed_score(F.col("transaction_id"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("open", "investigating", "resolved", "dismissed")]),
                          (F.col("transaction_id") % 4 + 1).cast("int"))
    return tx.select(
        F.col("transaction_id").alias("id"), F.col("event_ts").alias("created_at"), "transaction_id",
        F.col("account_id").alias("entity_id"), "device_id", "merchant_id", "amount", "event_time_seconds",
        score.alias("risk_score"), verdict(score).alias("risk_label"), status.alias("status"), "is_fraud")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts with the five stored features as flat columns (``sum_amount_1h`` is the amount at risk)."""
    base = plain_alerts(spark, folder).withColumnRenamed("entity_id", "account_id")
    base = features.velocity(base)
    base = features.amount_1h(base)
    return features.device_shift(base).drop("avg_amount_1h").withColumnRenamed("account_id", "entity_id")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Analyst dispositions: every purchase is reviewed, and every purchase above 100 twice, the second time later
    and with the opposite label."""
    reviewed = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    confirmed = F.col("event_id") % 2 == 0
    reviews = F.when(F.col("value") > 100, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = reviewed.withColumn("round", F.explode(reviews))
    return rows.select(
        (F.col("event_id") * 2 + F.col("round")).alias("id"), F.col("event_id").alias("alert_id"),
        (utc("ts") + F.make_dt_interval(hours=F.col("round"))).alias("created_at"),
        F.when(confirmed == (F.col("round") == 1), "confirmed_fraud").otherwise("false_positive").alias("label"),
        F.concat(F.lit("analyst"), (F.col("user_id") % 5).cast("string")).alias("analyst"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """One note per sign-up alert and a second one where the amount is above 50."""
    rows = table(spark, folder, "events").where(F.col("event_type") == "signup")
    count = F.when(F.col("value") > 50, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("no", F.explode(count))
    return rows.select(
        (F.col("event_id") * 2 + F.col("no")).alias("id"), F.col("event_id").alias("alert_id"),
        (utc("ts") + F.make_dt_interval(mins=F.col("no") * 10)).alias("created_at"),
        F.concat(F.lit("analyst"), (F.col("user_id") % 5).cast("string")).alias("author"),
        F.concat(F.lit("note "), F.col("no").cast("string"), F.lit(" on "), F.col("event_id").cast("string")).alias("body"))


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """One action per click alert; the actor is a user id."""
    rows = table(spark, folder, "events").where(F.col("event_type") == "click")
    return rows.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("target_id"),
        (utc("ts") + F.make_dt_interval(mins=F.lit(30))).alias("created_at"),
        F.col("user_id").alias("actor_id"), F.concat(F.lit("set_status:"), F.col("event_type")).alias("action"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users; some actors have no row here."""
    rows = table(spark, folder, "customer").where(F.col("c_acctbal") > 0)
    return rows.select(F.col("c_custkey").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw text rows with dirt: unreadable and blank amounts, blank accounts, odd merchant spelling, and
    a second copy of every large row."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    amount = F.when(F.col("value") < 0.5, "").when(F.col("value") < 0.7, "n/a").otherwise(F.col("value").cast("string"))
    fraud = F.when(F.col("event_type") == "view", None).when(
        (F.col("event_type") == "error") & (F.col("value") > 60), "1").otherwise("0")
    seconds = F.floor((F.unix_micros(utc("ts")) - FAST_CLOCK_START * 1_000_000) / 60_000_000).cast("long")
    copies = F.when(F.col("value") > 300, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = events.withColumn("_copy", F.explode(copies))
    return rows.select(
        F.col("event_id").cast("string").alias("TransactionID"), fraud.alias("isFraud"),
        seconds.cast("string").alias("TransactionDT"), amount.alias("TransactionAmt"),
        F.upper(F.substring("event_type", 1, 1)).alias("ProductCD"),
        F.when(k != "7", F.col("user_id").cast("string")).alias("card1"),
        F.lit("visa").alias("card4"), F.lit("debit").alias("card6"),
        F.when(k != "13", F.concat(F.lit(" M"), k, F.lit(" "))).alias("P_emaildomain"),
        F.lit(None).cast("string").alias("R_emaildomain"))


def raw_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Identity rows for all events but views, and one orphan per customer in debt."""
    events = table(spark, folder, "events").where(F.col("event_type") != "view")
    k = F.get_json_object("props", "$.k")
    known = events.select(
        F.col("event_id").cast("string").alias("TransactionID"),
        F.concat(F.upper("event_type"), F.lit(" ")).alias("DeviceType"),
        F.when(k != "5", F.concat(F.lit("Info-"), F.right(k, F.lit(1)))).alias("DeviceInfo"),
        k.alias("id_01"), F.lit(None).cast("string").alias("id_31"))
    orphans = table(spark, folder, "customer").where(F.col("c_acctbal") < 0).select(
        (F.col("c_custkey") + 999_000_000_000).cast("string").alias("TransactionID"), F.lit("MOBILE").alias("DeviceType"),
        F.lit("Info-x").alias("DeviceInfo"), F.lit("0").alias("id_01"), F.lit(None).cast("string").alias("id_31"))
    return known.unionByName(orphans)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan of very few files whose rows are expensive to expand; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as card transactions with account, device, card and address keys."""
    lines = spread(table(spark, folder, "lineitem")).join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.to_date(c).cast("string")
    keys = {
        "Device": F.concat(F.lit("dev_"), day("o_orderdate"), F.lit("|"), F.col("o_orderpriority")),
        "Card": F.concat(F.lit("card_"), F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_quantity").cast("int").cast("string")),
        "Address": F.concat(F.lit("addr_"), F.col("l_suppkey").cast("string"), F.lit("|"), day("l_shipdate")),
    }
    return lines.select(
        F.col("o_custkey").cast("string").alias("account"), *[c.alias(k) for k, c in keys.items()],
        *[c.alias(f"{k}_label") for k, c in keys.items()], F.col("l_extendedprice").alias("amount"),
        (F.col("o_custkey") * 7919 % 997 / 997).alias("risk"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("day"))


def raw_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the raw card, address and device columns, some of them blank or unknown."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_shipdate").cast("string")).alias("row"),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_custkey").cast("string")).alias("card1"),
        F.col("l_partkey").alias("card2"), F.lit(None).cast("string").alias("card3"), F.lit("visa").alias("card4"),
        F.col("l_quantity").cast("int").alias("card5"), F.lit("debit").alias("card6"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("addr1"), F.col("l_linenumber").alias("addr2"),
        F.lower("l_linestatus").alias("DeviceType"),
        F.when(F.col("l_returnflag") == "A", "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("DeviceInfo"))
