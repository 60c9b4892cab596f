"""Checks on a raw batch, the report row, and the gate.

Checks look at the raw batch under canonical names, before incomplete and repeated rows are dropped, so that each
of them can fail.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.contracts import CANONICAL, QualityBounds
from riskloom.operators import cleaning

REPORT = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("checked_at", T.TimestampType()),
    T.StructField("bronze_rows", T.LongType()), T.StructField("silver_rows", T.LongType()),
    T.StructField("rowcount_shrink_rate", T.DoubleType()), T.StructField("duplicate_rate", T.DoubleType()),
    T.StructField("orphan_identity_rows", T.LongType()), T.StructField("drift_detected", T.BooleanType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("null_rates", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("new_columns", T.ArrayType(T.StringType())),
    T.StructField("missing_columns", T.ArrayType(T.StringType())),
    T.StructField("failures", T.ArrayType(T.StringType())),
])


class QualityFailure(Exception):
    """The batch must not be published."""


def canonical(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(CANONICAL)


def _missing(name: str, dtype: str) -> Column:
    empty = F.col(name).isNull()
    return empty | (F.trim(F.col(name)) == "") if dtype == "string" else empty


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate) for every column in one pass; blank strings count as null."""
    rates = {n: F.round(F.avg(_missing(n, t).cast("double")), 6) for n, t in df.dtypes}
    wide = df.agg(*[F.coalesce(r, F.lit(0.0)).alias(n) for n, r in rates.items()])
    return wide.unpivot([], list(rates), "column_name", "null_rate")


def null_breaches(rates: DataFrame, bounds: QualityBounds = QualityBounds()) -> DataFrame:
    bound = F.create_map(*[F.lit(x) for pair in bounds.null_rate.items() for x in pair])
    limited = rates.withColumn("bound", F.try_element_at(bound, F.col("column_name")))
    return limited.where(F.col("null_rate") > F.col("bound"))


def duplicate_rate(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Repeated keys as a share of all rows, on the raw batch."""
    repeated = (F.count(key) - F.count_distinct(F.col(key))) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return df.agg(F.coalesce(F.round(repeated, 6), F.lit(0.0)).alias("duplicate_rate"))


def reconcile(raw: DataFrame) -> DataFrame:
    """Rows in, rows that cleaning keeps, and the shrink, per batch."""
    typed = cleaning.enforce_types(raw)
    kept = F.count_distinct(F.when(cleaning.complete(), F.col("transaction_id")))
    counted = typed.groupBy("_batch_id").agg(F.count(F.lit(1)).alias("bronze_rows"), kept.alias("silver_rows"))
    return counted.withColumn("shrink", F.round((F.col("bronze_rows") - F.col("silver_rows")) / F.col("bronze_rows"), 6))


def schema_drift(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns that appeared or went missing against the declared contract; lineage columns do not count."""
    actual = {c for c in df.columns if not c.startswith("_")}
    return {"new": sorted(actual - set(expected)), "missing": sorted(set(expected) - actual)}


def assess(raw: DataFrame, identity: DataFrame | None, batch_id: str, checked_at, expected: list[str],
           bounds: QualityBounds = QualityBounds(), drift: dict[str, list[str]] | None = None) -> DataFrame:
    """The one-row report of a batch. Reads only the columns it checks; nothing has been published yet. ``drift``: of the columns as
    they landed, where ``raw`` has been completed since."""
    named = canonical(raw)
    typed = cleaning.enforce_types(raw)
    drift = schema_drift(raw, expected) if drift is None else drift
    watched = [c for c in bounds.null_rate if c in named.columns]
    rates = {r.column_name: r.null_rate for r in null_rates(named.select(*watched)).collect()}
    row = typed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.when(cleaning.complete(), F.col("transaction_id"))).alias("kept"),
        F.count("transaction_id").alias("ids"),
        F.count_distinct("transaction_id").alias("distinct_ids")).first()
    lost = 0
    if identity is not None:
        usable = cleaning.drop_incomplete(typed)
        lost = cleaning.orphans(usable, identity).count()
    share = lambda part: round(part / row.rows, 6) if row.rows else 0.0
    shrink, repeated = share(row.rows - row.kept), share(row.ids - row.distinct_ids)
    failures = [f"null rate of {c} is {rates[c]:.4f}, bound {b}" for c, b in bounds.null_rate.items()
                if rates.get(c, 1.0) > b]
    if repeated > bounds.duplicate_rate:
        failures.append(f"duplicate rate is {repeated:.4f}, bound {bounds.duplicate_rate}")
    if shrink > bounds.shrink:
        failures.append(f"shrink is {shrink:.4f}, bound {bounds.shrink}")
    report = (batch_id, checked_at, row.rows, row.kept, shrink, repeated, lost, bool(drift["new"] or drift["missing"]),
              not failures, rates, drift["new"], drift["missing"], failures)
    return raw.sparkSession.createDataFrame([report], REPORT)


def flat_report(report: DataFrame) -> DataFrame:
    """The 12-column form with nested parts as JSON text."""
    drift = F.struct(F.col("new_columns").alias("new"), F.col("missing_columns").alias("missing"))
    return report.select(
        "batch_id", "checked_at", "bronze_rows", "silver_rows", "rowcount_shrink_rate", "duplicate_rate",
        "orphan_identity_rows", "drift_detected", "passed", F.to_json("null_rates").alias("null_rates_json"),
        F.to_json(drift).alias("schema_drift_json"), F.to_json("failures").alias("failures_json"))


def gate(report: DataFrame) -> None:
    """Raise when the report says that the batch failed."""
    row = report.first()
    if not row.passed:
        raise QualityFailure("; ".join(row.failures))


def latest_report(history: DataFrame) -> DataFrame:
    """The newest run with its row counts."""
    newest = F.max_by(F.struct("batch_id", "bronze_rows", "silver_rows", "passed"), F.struct("checked_at", "batch_id"))
    return history.agg(newest.alias("r"), F.count(F.lit(1)).alias("runs")).select("r.*", "runs")


def top_null_rates(rates: DataFrame, k: int = 12) -> DataFrame:
    return rates.orderBy(F.desc("null_rate"), "column_name").limit(k)
