"""The fact table brought up to date with one batch, at the cost of that batch.

Three things stand beside the fact table. The ledger names the batches that are in it with the span of their event times, and the
folder of the state. The state has one row per account: its last transaction, and number, mean and squared deviations of
its amounts so far. With both, a batch reads: its own clean rows; of other batches only those whose times
reach into the widest window before them; the state of its accounts; and of the fact table the days that change.

An account whose new rows all come after its last one needs no more than that. An account that gets rows at or before its last one is
computed anew from all of its clean rows, and its rows from there on are replaced. The result is that of a rebuild: counts, sums, merchants and
devices are equal, z-scores up to the rounding of doubles, because moments are merged.

A run that breaks off before its ledger entry can be repeated: rows are replaced by id, and an account whose state is already
ahead counts as one with earlier rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import features, star
from riskloom.operators.features import KEY, ORDER, TIME, _moments_zscore, _sequence
from riskloom.operators.ordered import HOT_ROWS, _merge_moments
from riskloom.session import materialise
from riskloom.sources import files
from riskloom.streaming import keyed

ROW = ["transaction_id", "account_id", "device_id", "merchant_id", "amount", "event_time_seconds", "event_ts", "is_fraud"]
REACH = max(features.COUNT_WINDOWS.values())


def _ledger(root: str) -> str:
    return f"{root}/gold/applied_batches"


def applied(spark: SparkSession, root: str) -> DataFrame | None:
    """(batch, low, high, state) of the batches in the fact table, or None."""
    return spark.read.parquet(_ledger(root)) if files.exists(spark, _ledger(root)) else None


def can_apply(spark: SparkSession, root: str, batch_id: str) -> bool:
    """Whether the fact table was built with a ledger and does not hold the batch yet; otherwise it takes a rebuild."""
    known = applied(spark, root)
    return known is not None and not known.where(F.col("batch") == batch_id).limit(1).count()


def write_fact(fact: DataFrame, root: str, files_per_day: int, rebuild: bool) -> None:
    """A day goes to a few files of equal size, whatever its accounts look like."""
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(files_per_day))
    files.write_table(fact.repartition("date_key", part), f"{root}/gold/fact_transactions", partition_by=["date_key"], rebuild=rebuild)


def clean_rows(spark: SparkSession, root: str) -> DataFrame:
    """The clean table with batch ids as they were given: without a schema, Spark reads the folder of batch 01 as the number 1."""
    path = f"{root}/silver/transactions_cleaned"
    found = files.read_table(spark, path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == "_batch_id" else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def start(spark: SparkSession, root: str, clean: DataFrame) -> None:
    """Ledger and state of a fact table just built from ``clean`` (with its ``_batch_id``)."""
    state, amount = f"{root}/gold/account_state/{uuid.uuid4().hex}", F.col("amount")
    count = F.count(amount).cast("double")
    moments = F.struct(count.alias("n"), F.coalesce(F.avg(amount), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(amount) * count, F.lit(0.0)).alias("m2"))
    _put_state(spark, state, clean.groupBy(KEY).agg(_last(F.struct(*ROW)).alias("last"), moments.alias("moments")))
    spans = clean.groupBy(F.col("_batch_id").alias("batch")).agg(F.min(TIME).alias("low"), F.max(TIME).alias("high"))
    files.write_table(spans.withColumn("state", F.lit(state)), _ledger(root))


def _last(row):
    return F.max_by(row, F.struct(*ORDER))


def _put_state(spark: SparkSession, path: str, per: DataFrame) -> None:
    newest = keyed._newest(spark, path)
    version = 0 if newest is None else (newest.agg(F.max(keyed.VERSION)).first()[0] or 0) + 1
    keyed.upsert(path, KEY, order=["seq"])(materialise(per.withColumn("seq", F.lit(version))), version)


def apply(spark: SparkSession, root: str, batch_id: str, files_per_day: int = 8, hot_rows: int | None = HOT_ROWS) -> int:
    """Adds the clean rows of a batch to the fact table; returns the number of days written."""
    silver = clean_rows(spark, root)
    known, of_batch = applied(spark, root), F.col("_batch_id") == batch_id
    new = silver.where(of_batch).select(*ROW)
    span = new.agg(F.min(TIME).alias("low"), F.max(TIME).alias("high")).first()
    if span.low is None:
        return 0
    ledger = known.collect()  # a row per batch, as many as the table has folders
    state_path = ledger[0].state
    first = new.groupBy(KEY).agg(F.min(TIME).alias("_first"))
    state = keyed.read(spark, state_path).select(KEY, "last", "moments")
    accounts = first.join(state, KEY, "left")
    accounts = materialise(accounts.withColumn("_late", F.coalesce(F.col(f"last.{TIME}") >= F.col("_first"), F.lit(False))))
    late = accounts.where("_late").select(KEY, "_first")

    # in order: the rows within the widest window before the batch, and each account's last row
    near = [r.batch for r in ledger if r.high >= span.low - REACH]
    before = silver.where(F.col("_batch_id").isin(near) & (F.col(TIME) >= span.low - REACH)).select(*ROW)
    on_time = accounts.where(~F.col("_late"))
    before = before.join(on_time.select(KEY, "_first", F.col("last.transaction_id").alias("_last_id")), KEY)
    before = before.where((F.col(TIME) >= F.col("_first") - REACH) & (F.col("transaction_id") != F.col("_last_id"))).select(*ROW)
    before = before.unionByName(on_time.where("last IS NOT NULL").select("last.*").select(*ROW))
    rows = before.withColumn("_counted", F.lit(False)).unionByName(new.join(on_time.select(KEY), KEY).select(*ROW).withColumn("_counted", F.lit(True)))
    if late.limit(1).count():  # these are read whole
        held = silver.where(F.col("_batch_id").isin([r.batch for r in ledger]) | of_batch).select(*ROW)
        rows = rows.unionByName(held.join(late.select(KEY), KEY, "left_semi").withColumn("_counted", F.lit(True)))

    base = accounts.select(KEY, "_first", F.when(~F.col("_late"), F.col("moments")).alias("_base"))
    rows = materialise(rows.join(base, KEY))
    out = _sequence(rows, {"_merged": ("moments", F.when(F.col("_counted"), F.col("amount")))}, hot_rows)
    out = out.withColumn("_merged", F.when(F.col("_base").isNull(), F.col("_merged")).otherwise(_merge_moments(F.col("_base"), F.col("_merged"))))
    out = features.behaviour(out, hot_rows).withColumn("amount_zscore", _moments_zscore(F.col("_merged")))
    changed = materialise(out.where(F.col("_counted") & (F.col(TIME) >= F.col("_first"))))

    fact = star.fact(changed)
    days = [r.date_key for r in fact.select("date_key").distinct().collect()]
    path = f"{root}/gold/fact_transactions"
    kept = spark.read.parquet(path).where(F.col("date_key").isin(days)).join(fact.select("transaction_id"), "transaction_id", "left_anti").select(*fact.columns)
    write_fact(materialise(kept.unionByName(fact)), root, files_per_day, rebuild=False)
    row = F.struct(*[F.col(c) for c in ROW])
    _put_state(spark, state_path, changed.groupBy(KEY).agg(_last(row).alias("last"), _last(F.col("_merged")).alias("moments")))
    entry = spark.createDataFrame([(batch_id, span.low, span.high, state_path)], known.schema)
    files.write_table(entry, _ledger(root), "append")
    return len(days)
