"""Files and tables at rest."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise, shared_dir

HEAD_BYTES = 8 * 1024 * 1024


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name beside the checkpoints, reachable by every executor."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with the columns that its header names, in any order and number; all stay text, no type is inferred. Any Hadoop scheme works."""
    return spark.read.option("header", True).csv(path)


def completed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def _plain_path(path: F.Column) -> F.Column:
    """One spelling of a path: readers write file:/x and file:///x."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/{1,3}(?=[^/])", "$1:/")


def with_lineage(df: DataFrame, batch_id: str, ingested_at=None, checksums: DataFrame | None = None) -> DataFrame:
    """Ingest time, batch id and source file; with ``checksums`` also the checksum of that file.

    ``df`` must come straight from a file reader, which knows the file of each row.
    """
    path = F.col("_metadata.file_path")
    named = ["_source_path"] if checksums is not None else []
    out = df.select(
        "*", (F.lit(ingested_at) if ingested_at else F.current_timestamp()).cast("timestamp").alias("_ingested_at"),
        F.lit(batch_id).alias("_batch_id"), F.element_at(F.split(path, "/"), -1).alias("_source_file"), *[_plain_path(path).alias(c) for c in named])
    if checksums is None:
        return out
    return out.join(checksums.select("_source_path", "_source_checksum"), "_source_path", "left")


def head_checksums(spark: SparkSession, path: str | list[str], head_bytes: int = HEAD_BYTES) -> DataFrame:
    """First 16 hex digits of the SHA-256 of each file's head; (missing) when there is no file.

    Spark lists the files (their content column is never read), tasks read only the head of each.
    """
    schema = "_source_file string, _source_checksum string, _source_path string"
    try:
        listed = spark.read.format("binaryFile").load(path).select("path")
    except AnalysisException:
        return spark.createDataFrame([(p.rsplit("/", 1)[-1], "missing", p) for p in ([path] if isinstance(path, str) else path)], schema)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            found = []
            for uri in pdf["path"]:
                system, name = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(name) as stream:
                    found.append((name.rsplit("/", 1)[-1], hashlib.sha256(stream.read(head_bytes)).hexdigest()[:16], uri))
            yield pd.DataFrame(found, columns=["_source_file", "_source_checksum", "_source_path"])

    return listed.mapInPandas(heads, schema).withColumn("_source_path", _plain_path(F.col("_source_path")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there; one that is there and cannot be read is for its reader to report."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def whole_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, checksum): SHA-256 of the whole content of each file, read in the tasks, a piece at a time."""
    listed = spark.read.format("binaryFile").load(path).select("path")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            found = []
            for uri in pdf["path"]:
                system, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while piece := stream.read(HEAD_BYTES):
                        digest.update(piece)
                found.append((uri, digest.hexdigest()))
            yield pd.DataFrame(found, columns=["file", "checksum"])

    return listed.mapInPandas(sums, "file string, checksum string")


def not_landed(spark: SparkSession, path: str, ledger: str, batch_id: str, table: str) -> DataFrame:
    """(file, checksum, fresh) of the files of a batch. Not fresh are those whose content another batch has landed in the same table, and all
    but one of files with equal content; what the batch itself landed before is fresh again, since a second run replaces it."""
    found = materialise(whole_checksums(spark, path))
    first = found.groupBy("checksum").agg(F.min("file").alias("file"))
    if exists(spark, ledger):
        known = spark.read.parquet(ledger).where((F.col("table") == table) & (F.col("_batch_id") != batch_id) & F.col("fresh"))
        first = first.join(known.select("checksum"), "checksum", "left_anti")
    return found.join(first.select("file", F.lit(True).alias("new")), "file", "left").select("file", "checksum", F.col("new").isNotNull().alias("fresh"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, rebuild: bool = False) -> None:
    """Parquet. With partitions, overwriting replaces only the partitions that ``df`` holds, unless it is a ``rebuild``."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if partition_by and not rebuild else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str) -> None:
    """Land a batch once: its partition is replaced, so a second run of the same batch changes nothing."""
    write_table(df, path, "overwrite", ["_batch_id"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with the schemas of all files merged."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows of the same shape when it does not exist."""
    try:
        return read_table(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def export_training(training: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """CSV and Parquet copies, and a manifest row. ``files`` bounds the number of files per copy if given."""
    out = training.coalesce(files) if files else training
    csv_path, parquet_path = f"{folder}/training_csv", f"{folder}/training_parquet"
    out.write.mode("overwrite").parquet(parquet_path)
    written = training.sparkSession.read.parquet(parquet_path)
    written.write.mode("overwrite").option("header", True).csv(csv_path)
    manifest = written.agg(F.count(F.lit(1)).alias("rows")).withColumns({
        "columns": F.array(*[F.lit(c) for c in training.columns]),
        "csv_path": F.lit(csv_path), "parquet_path": F.lit(parquet_path)})
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def read_scoring_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows to score in bulk. Header names are lower-cased and trimmed, only ``amount`` is required, unreadable numbers
    take their default, and rows without an id get one from their content."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "amount" not in raw.columns:
        raise ValueError("an amount column is required")

    def number(name: str, default) -> F.Column:
        parsed = F.col(name).try_cast("double") if name in raw.columns else F.lit(None).cast("double")
        return F.coalesce(parsed, default if not isinstance(default, (int, float)) else F.lit(float(default)))

    def text(name: str, default) -> F.Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), default) if name in raw.columns else default

    row_id = F.concat(F.lit("row_"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in sorted(raw.columns)])))
    amount = number("amount", 0.0)
    return raw.select(
        text("transaction_id", row_id).alias("transaction_id"), text("entity_id", row_id).alias("entity_id"),
        amount.alias("amount"), number("device_shift", 0).cast("int").alias("device_shift"),
        number("tx_count_5m", 1).cast("long").alias("tx_count_5m"), number("tx_count_1h", 1).cast("long").alias("tx_count_1h"),
        number("tx_count_24h", 1).cast("long").alias("tx_count_24h"), number("sum_amount_1h", amount).alias("sum_amount_1h"))


def export_alerts(alerts: DataFrame, path: str) -> None:
    """The eight export columns as CSV, newest first; the sort is a range partitioning, not one task."""
    columns = ["created_at", "transaction_id", "entity_id", "risk_score", "risk_label", "status", "assignee", "action_taken"]
    filled = alerts.withColumns({c: F.lit(None).cast("string") for c in columns if c not in alerts.columns})
    filled.orderBy(F.desc("created_at"), "transaction_id").select(*columns).write.option("header", True).csv(path)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """A deterministic row-limited scan."""
    return df.orderBy(order).limit(n)
