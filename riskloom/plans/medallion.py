"""Raw files to clean table to star schema to training set. Stages meet only in storage, so each can run alone:

    spark-submit -m riskloom.plans.medallion --stage all --transactions T --identity I --root R --batch B
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.contracts import RAW_IDENTITY, RAW_TRANSACTION, QualityBounds
from riskloom.operators import cleaning, features, quality, star
from riskloom.plans import increments
from riskloom.session import materialise, pin_utc
from riskloom.sources import files

STAGES = ("bronze", "silver", "gold", "export")


def bronze(spark: SparkSession, transactions: str, identity: str | None, root: str, batch_id: str) -> None:
    """Land the files of a batch whose content no other batch has landed; the ledger names all of its files, landed or not."""
    ledger = f"{root}/bronze/landed_files"
    for path, name in ((transactions, "transactions"), (identity, "identity")):
        if path is None:
            continue
        listed = materialise(files.not_landed(spark, path, ledger, batch_id, name))
        fresh = [r.file for r in listed.where("fresh").select("file").orderBy("file").collect()]  # Spark lists the files it reads on the driver, too
        if fresh:
            raw = files.with_lineage(files.read_raw(spark, fresh), batch_id, checksums=files.head_checksums(spark, fresh))
            files.write_batch(raw, f"{root}/bronze/{name}")
        rows = listed.withColumns({"table": F.lit(name), "_batch_id": F.lit(batch_id)})
        files.write_table(rows, ledger, partition_by=["table", "_batch_id"])


def _batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame | None:
    """The rows that one batch landed, with its own columns, or None."""
    folder = f"{path}/_batch_id={batch_id}"
    return spark.read.parquet(folder).withColumn("_batch_id", F.lit(batch_id)) if files.exists(spark, folder) else None


def _all_known(spark: SparkSession, root: str, batch_id: str) -> bool:
    """Whether the batch is in the ledger, so that it landed nothing because other batches had."""
    ledger = f"{root}/bronze/landed_files"
    listed = spark.read.parquet(ledger) if files.exists(spark, ledger) else None
    return listed is not None and bool(listed.where((F.col("table") == "transactions") & (F.col("_batch_id") == batch_id)).limit(1).count())


def silver(spark: SparkSession, root: str, batch_id: str, bounds: QualityBounds = QualityBounds()) -> DataFrame | None:
    """Assess the batch by itself, keep the report, stop on failure, and only then publish its clean rows.

    Other batches are neither read again nor published. A transaction that another batch has published stays as it is there,
    so the same rows under a new batch id add nothing. A batch whose files had all landed before has no report; one that
    never landed is an error.
    """
    landed = _batch(spark, f"{root}/bronze/transactions", batch_id)
    if landed is None:
        if _all_known(spark, root, batch_id):
            return None
        raise ValueError(f"batch {batch_id} has landed no transactions in {root}/bronze")
    identity = _batch(spark, f"{root}/bronze/identity", batch_id)
    batch = files.completed(landed, RAW_TRANSACTION)
    identity = files.completed(identity, RAW_IDENTITY) if identity is not None else spark.createDataFrame([], RAW_IDENTITY)
    drift = quality.schema_drift(landed, RAW_TRANSACTION.names)
    report = quality.assess(batch, identity, batch_id, datetime.datetime.now(datetime.UTC), RAW_TRANSACTION.names, bounds, drift)
    files.write_table(quality.flat_report(report), f"{root}/silver/dq_report", "append")
    quality.gate(report)
    path, rows = f"{root}/silver/transactions_cleaned", cleaning.clean(batch, identity)
    if files.exists(spark, path):
        others = spark.read.parquet(path)
        rows = rows.join(others.where(F.col("_batch_id") != batch_id).select("transaction_id"), "transaction_id", "left_anti").select(*rows.columns)
    files.write_batch(materialise(rows.withColumn("_batch_id", F.lit(batch_id))), path)
    return report


def gold(spark: SparkSession, root: str, files_per_day: int = 8, batch_id: str | None = None) -> None:
    """Fact table and dimensions. A ``batch_id`` that the fact table does not hold yet is added to it; otherwise it is built anew.

    The dimensions need no features, so they read the clean table and not the windowed plan.
    """
    tx = increments.clean_rows(spark, root)
    if batch_id is not None and increments.can_apply(spark, root, batch_id):
        increments.apply(spark, root, batch_id, files_per_day)
    else:
        increments.write_fact(star.fact(features.behaviour(tx)), root, files_per_day, rebuild=True)
        increments.start(spark, root, tx)
    for name, build in (("dim_account", star.dim_account), ("dim_device", star.dim_device), ("dim_date", star.dim_date)):
        files.write_table(build(tx), f"{root}/gold/{name}")


def export(spark: SparkSession, root: str) -> DataFrame:
    fact = files.read_table(spark, f"{root}/gold/fact_transactions")
    return files.export_training(star.training_set(fact), f"{root}/export")


def run(spark: SparkSession, transactions: str, identity: str | None, root: str, batch_id: str, stage: str = "all") -> None:
    pin_utc(spark)
    for name in STAGES if stage == "all" else (stage,):
        if name == "bronze":
            bronze(spark, transactions, identity, root, batch_id)
        elif name == "silver":
            silver(spark, root, batch_id)
        elif name == "gold":
            gold(spark, root, batch_id=batch_id)
        else:
            export(spark, root)


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--stage", choices=("all", *STAGES), default="all")
    for option in ("transactions", "identity", "root", "batch"):
        parser.add_argument(f"--{option}", required=option in ("root", "batch"))
    args = parser.parse_args()
    run(SparkSession.builder.getOrCreate(), args.transactions, args.identity, args.root, args.batch, args.stage)
