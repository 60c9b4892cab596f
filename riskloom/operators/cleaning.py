"""Raw string rows to clean transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.contracts import CANONICAL, CLEAN_COLUMNS
from riskloom.operators.ranking import survivors


def normal(col: Column | str) -> Column:
    """Consistent case and no surrounding blanks."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def enforce_types(raw: DataFrame) -> DataFrame:
    """Canonical names and types; values that do not parse become null, a null label becomes 0."""
    named = raw.withColumnsRenamed(CANONICAL)
    return named.withColumns({
        "transaction_id": F.col("transaction_id").try_cast("long"),
        "event_time_seconds": F.col("event_time_seconds").try_cast("double"),
        "amount": F.col("amount").try_cast("double"),
        "is_fraud": F.coalesce(F.col("is_fraud").try_cast("int"), F.lit(0)),
        "merchant_source": normal("merchant_source"),
    })


def complete() -> Column:
    """Rows without id, amount or time cannot be used."""
    return F.col("transaction_id").isNotNull() & F.col("amount").isNotNull() & F.col("event_time_seconds").isNotNull()


def drop_incomplete(typed: DataFrame) -> DataFrame:
    return typed.where(complete())


def deduplicate(df: DataFrame) -> DataFrame:
    """One row per transaction id: the earliest ingested, then by all columns."""
    return survivors(df, ["transaction_id"], [c for c in ("_ingested_at", "_batch_id") if c in df.columns])


def clean_identity(identity: DataFrame) -> DataFrame:
    typed = identity.select(
        F.col("TransactionID").try_cast("long").alias("transaction_id"),
        normal("DeviceType").alias("device_type"), normal("DeviceInfo").alias("device_info"))
    return survivors(typed.where(F.col("transaction_id").isNotNull()), ["transaction_id"], [])


def join_identity(tx: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Left join on the id. ``has_identity`` says that device info is known, ``identity_matched`` that a row joined."""
    if identity is None:
        return tx.withColumns({
            "device_type": F.lit(None).cast("string"), "device_info": F.lit(None).cast("string"),
            "has_identity": F.lit(False), "identity_matched": F.lit(False)})
    matched = clean_identity(identity).withColumn("_matched", F.lit(True))
    return tx.join(matched, "transaction_id", "left").withColumns({
        "has_identity": F.col("device_info").isNotNull(),
        "identity_matched": F.coalesce(F.col("_matched"), F.lit(False))}).drop("_matched")


def orphans(tx: DataFrame, identity: DataFrame) -> DataFrame:
    """Identity rows whose transaction is missing."""
    return clean_identity(identity).join(tx.select("transaction_id"), "transaction_id", "left_anti")


def entities(joined: DataFrame, reference_epoch: int = 0, isolate_unknown: bool = False) -> DataFrame:
    """Account, device and merchant ids, and the event time as a timestamp.

    All rows without an account share the account ``unknown``; ``isolate_unknown`` gives each its own instead.
    """
    unknown = F.lit("unknown")
    if isolate_unknown:
        unknown = F.concat(F.lit("unknown:"), F.col("transaction_id").cast("string"))
    return joined.withColumns({
        "account_id": F.coalesce(F.col("account_source"), unknown),
        "device_id": F.concat_ws(":", F.coalesce("device_type", F.lit("na")), F.coalesce("device_info", F.lit("na"))),
        "merchant_id": F.coalesce("merchant_source", F.lit("unknown")),
        "event_ts": F.timestamp_seconds(F.col("event_time_seconds") + F.lit(float(reference_epoch))),
    })


def clean(raw: DataFrame, identity: DataFrame | None, **options) -> DataFrame:
    """All steps in order, with the fixed output columns."""
    tx = deduplicate(drop_incomplete(enforce_types(raw)))
    return entities(join_identity(tx, identity), **options).select(*CLEAN_COLUMNS)
