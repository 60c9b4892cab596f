"""A table with one row per key, written by a stream.

Rows are dealt into buckets by a hash of the key. A trigger writes its rows of each bucket under its own version and then adds a row
per bucket to the manifest; a reader takes the versions in the manifest and folds the rows of a key, so that it sees a trigger whole or
not at all, and a trigger that is retried either finds itself in the manifest and does nothing, or overwrites what it left behind. Once
the versions since a bucket was last folded hold as many rows as that one, a trigger folds the bucket into its own version (``since``
in the manifest); so a trigger costs its rows, and folding a number of times the table that grows with the logarithm of its triggers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, VERSION = "_bucket", "_version"
SINCE, ROWS, KEY, ORDER = "_since", "_rows", "_key", "_order"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing was written yet; what is there and cannot be read is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # a folder without a file: the first trigger broke off
            raise
        return None


def _newest(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, version): at most one row per bucket."""
    manifest = _stored(spark, f"{path}/manifest")
    return None if manifest is None else manifest.groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION))


def _live(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, version, since, rows, key, order) of the versions that make up the table."""
    manifest = _stored(spark, f"{path}/manifest")
    if manifest is None:
        return None
    since = manifest.groupBy(BUCKET).agg(F.max(SINCE).alias("_last"))
    return manifest.join(since, BUCKET).where(F.col(VERSION) >= F.col("_last")).drop("_last")


def _rows(spark: SparkSession, path: str, live: DataFrame) -> DataFrame:
    data = spark.read.parquet(f"{path}/data")
    return data.join(F.broadcast(live.select(BUCKET, VERSION)), [BUCKET, VERSION])  # bounded by the buckets and the triggers since they were folded; prunes the folders read


def _folded(rows: DataFrame, columns: list[str], key: str, order: list[str] | None) -> DataFrame:
    """One row per key, with its bucket."""
    rest = F.struct(*[c for c in columns if c != key])
    best = F.max_by(rest, F.struct(*order, VERSION)) if order else F.min_by(rest, F.struct(VERSION, rest))
    return rows.groupBy(BUCKET, key).agg(best.alias("r")).select(BUCKET, key, "r.*").select(*columns, BUCKET)


def upsert(path: str, key: str, order: list[str] | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps one row per key: the one stored first, or the last by ``order``.

    Of one trigger's rows of a key the least by all columns is kept without ``order``. The table belongs to one stream: versions
    are its trigger numbers. Rows without a key are left out.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        live = _live(spark, path)
        stored = [] if live is None else live.select(BUCKET, VERSION, SINCE, ROWS).collect()  # bounded as in _rows
        if any(r[VERSION] == epoch for r in stored):
            return  # written before a retry
        columns = batch.columns
        new = batch.where(F.col(key).isNotNull()).withColumn(BUCKET, bucket_of(F.col(key), buckets)).withColumn(VERSION, F.lit(epoch).cast("int"))
        new = new.persist()
        try:
            touched = {r[0]: r[1] for r in new.groupBy(BUCKET).count().collect()}  # at most ``buckets``
            if not touched:
                return
            since, base, later = {r[BUCKET]: r[SINCE] for r in stored}, {}, {}
            for r in stored:
                at = base if r[VERSION] == r[SINCE] else later
                at[r[BUCKET]] = at.get(r[BUCKET], 0) + r[ROWS]
            fold = [b for b, n in touched.items() if b in base and later.get(b, 0) + n >= base[b]]
            rows = new
            if fold:
                rows = _rows(spark, path, live.where(F.col(BUCKET).isin(fold))).select(*columns, BUCKET, VERSION).unionByName(new)
            kept = _folded(rows, columns, key, order).withColumn(VERSION, F.lit(epoch).cast("int"))
            _put(kept.repartition(BUCKET), f"{path}/data", VERSION, BUCKET)
            found = [(b, epoch, epoch if b in fold or b not in base else since[b], n + (base[b] + later.get(b, 0) if b in fold else 0), key, order) for b, n in touched.items()]
            schema = f"{BUCKET} int, {VERSION} int, {SINCE} int, {ROWS} bigint, {KEY} string, {ORDER} array<string>"
            _put(spark.createDataFrame(found, schema).coalesce(1), f"{path}/manifest", VERSION)
        finally:
            new.unpersist()
    return write


def _put(rows: DataFrame, path: str, *folders: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest whole trigger."""
    live = _live(spark, path)
    if live is None:
        raise ValueError(f"nothing was written to {path} yet")
    by, rows = live.select(KEY, ORDER).first(), _rows(spark, path, live)
    return _folded(rows, [c for c in rows.columns if c not in (BUCKET, VERSION)], by[0], by[1]).drop(BUCKET)
