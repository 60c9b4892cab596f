"""Event streams: sources, parsing, sinks and replay of a table in time order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.contracts import EVENT
from riskloom.functions.scalar import parse_iso
from riskloom.operators.ordered import SLICE
from riskloom.sources.files import scratch

TOPIC = "raw-transactions"
ROWS_PER_TRIGGER = 1_000_000  # bounds what one key can bring into one task
PARTS_PER_CORE = 2  # of the state, in a run over what is there now


def from_kafka(spark: SparkSession, servers: str, topic: str = TOPIC, rows_per_trigger: int = ROWS_PER_TRIGGER) -> DataFrame:
    """Raw messages (``value`` as text, arrival ``timestamp``) keyed by entity."""
    messages = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option(
        "maxOffsetsPerTrigger", rows_per_trigger).load()
    return messages.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived_at"))


def from_text(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Raw messages from text files, one JSON object per line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.withColumn("arrived_at", F.current_timestamp())


def from_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse(messages: DataFrame) -> DataFrame:
    """Events with ``event_ts``; unreadable times take the arrival time. ``valid`` is false for broken or key-less messages."""
    parsed = messages.withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}))
    valid = F.col("e.entity_id").isNotNull() & (F.col("e.entity_id") != "") & F.col("e.amount").isNotNull()
    return parsed.select(
        "value", "e.transaction_id", "e.entity_id", "e.amount", "e.merchant_id", "e.device_fingerprint",
        parse_iso(F.col("e.timestamp"), F.col("arrived_at")).alias("event_ts"), F.coalesce(valid, F.lit(False)).alias("valid"))


def route(parsed: DataFrame, good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes valid events and rejected messages to two tables."""
    def write(batch: DataFrame, epoch: int) -> None:
        stamped = batch.withColumn("_epoch", F.lit(epoch))
        for rows, path in ((stamped.where("valid").drop("valid", "value"), good), (stamped.where("not valid").select("value", "_epoch"), bad)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(path)
    return write


def epoch_table(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A batch function that appends to a table once: a retried epoch replaces its own partition."""
    def write(batch: DataFrame, epoch: int) -> None:
        prepare(batch).withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(path)
    return write


def latest_table(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keep the newest row per key of each epoch; :func:`read_latest` folds the epochs. Nothing old is rewritten."""
    def newest(batch: DataFrame) -> DataFrame:
        whole = F.struct(*[c for c in batch.columns if c != key])
        return batch.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("r")).select(key, "r.*")
    return epoch_table(path, newest)


def read_latest(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("_epoch")
    whole = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("r")).select(key, "r.*")


def notifications(scored: DataFrame) -> DataFrame:
    """A message text per FRAUD verdict."""
    text = F.format_string("FRAUD detected: transaction %s, entity %s, risk score %s%%", F.col("transaction_id").cast("string"),
                           F.col("entity_id"), F.round(F.col("risk_score") * 100, 1).cast("string"))
    return scored.where(F.col("risk_label") == "FRAUD").select("transaction_id", text.alias("message"))


def feature_updates(features: DataFrame) -> DataFrame:
    """What the feature store tells its readers: entity, event time, updated fields."""
    fields = ["tx_count_5m", "tx_count_1h", "tx_count_24h", "amount_1h", "zscore", "merchants"]
    return features.select("entity_id", "event_ts", F.array(*[F.lit(f) for f in fields]).alias("updates_applied"))


def start(stream: DataFrame, sink: str | Callable[[DataFrame, int], None], mode: str = "append", available_now: bool = True,
          checkpoint: str | None = None) -> StreamingQuery:
    """Start a query into a Parquet folder or a batch function, with state in RocksDB and a shared checkpoint.

    A trigger commits what it changed in the state, not a snapshot of all of it. Each part of the state costs every trigger a task, whatever
    the rows, so a run over what is there now has at most some parts a core; a stream that stays keeps the session's number, which
    its checkpoint holds on to.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch(spark, "stream"))
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)
    if not available_now:
        return writer.start()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", min(parts, PARTS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        return writer.trigger(availableNow=True).start()  # it runs in a copy of the session as it is here
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def run(stream: DataFrame, sink=None, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = stream.sparkSession
    path = sink or scratch(spark, "stream-out")
    query = start(stream, path, mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replay(df: DataFrame, order: list[str], rows_per_file: int = ROWS_PER_TRIGGER, least: int = 4, text: bool = False, last: DataFrame | None = None) -> str:
    """Write a table as files in time order, so that a file stream sees the rows as they happened. Returns the folder.

    The order is cut into range slices by one job; the slices are then put into the folder one after another, because a
    file stream goes by modification time. ``last`` is a small table that arrives after all others.
    """
    spark = df.sparkSession
    n = max(least, math.ceil(df.count() / rows_per_file))
    slices, path = scratch(spark, "slices"), scratch(spark, "replay")
    df.repartitionByRange(n, *order).withColumn(SLICE, F.spark_partition_id()).write.partitionBy(SLICE).parquet(slices)
    ordered = spark.read.parquet(slices)
    for k in range(n):
        one = ordered.where(F.col(SLICE) == k).select(*df.columns).coalesce(1)
        (one.select("value").write.mode("append").text(path) if text else one.write.mode("append").parquet(path))
    if last is not None:
        one = last.coalesce(1)
        (one.select("value").write.mode("append").text(path) if text else one.write.mode("append").parquet(path))
    return path


def heartbeat(df: DataFrame, after: str = "1 day", time: str = "event_ts") -> DataFrame:
    """A row of nulls with a time ``after`` the last one: it moves the watermark past all rows and is no event itself."""
    later = df.agg(F.max(time).alias("t"), F.count(F.lit(1)).alias("n")).where("n > 0")
    fields = [(F.col("t") + F.expr(f"INTERVAL {after}") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return later.select(*fields)


def for_features(parsed: DataFrame) -> DataFrame:
    """Valid messages in the shape that the feature state reads: the device, and the event time in seconds, under their names there."""
    return parsed.where("valid").select(
        "transaction_id", "entity_id", "amount", F.col("device_fingerprint").alias("device_id"), "merchant_id", "event_ts",
        (F.unix_micros("event_ts") / 1_000_000).alias("event_time_seconds"))
