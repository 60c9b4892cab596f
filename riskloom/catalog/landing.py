"""Raw files, cleaning, quality checks, star schema and exports."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import CLEAN, FEATURES, PLAIN_ALERTS, RAW, TX, TYPED
from riskloom.contracts import CLEAN_COLUMNS, RAW_IDENTITY, RAW_TRANSACTION
from riskloom.operators import cleaning, features, quality, star
from riskloom.plans import medallion
from riskloom.sources import files, tables


def _landed(spark, folder):
    """The raw rows as CSV files."""
    path = files.scratch(spark, "raw-csv")
    tables.raw_transactions(spark, folder).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _batch(spark, folder, batch_id="b1"):
    return tables.raw_transactions(spark, folder).withColumn("_batch_id", F.lit(batch_id))


# ---------------------------------------------------------------- sources and sinks

@query("src1_raw_csv_scan", f"""WITH {RAW} SELECT "TransactionID", "isFraud", "TransactionDT",
nullif("TransactionAmt", '') AS "TransactionAmt", card1, "P_emaildomain" FROM raw""")
def src1(spark, folder):
    raw = files.read_raw(spark, _landed(spark, folder))
    return raw.select("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "card1", "P_emaildomain")


@query("src2_lineage", "SELECT event_id, '2024-06-01' AS _batch_id, 'events.parquet' AS _source_file, "
                       "TIMESTAMP '2024-06-01 00:00:00' AS _ingested_at FROM events")
def src2(spark, folder):
    events = tables.table(spark, folder, "events")
    out = files.with_lineage(events, "2024-06-01", datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC))
    return tables.ntz(out.select("event_id", "_batch_id", "_source_file", "_ingested_at"), "_ingested_at")


@query("src3_head_checksums")
def src3(spark, folder):
    return files.head_checksums(spark, f"{folder}/*.parquet").drop("_source_path")


@query("src4_idempotent_append", f"""WITH {RAW} SELECT b AS _batch_id, count(*) AS batch_rows,
count(DISTINCT "TransactionID") AS ids FROM raw, (SELECT 'b1' AS b UNION ALL SELECT 'b2') GROUP BY b""")
def src4(spark, folder):
    path = files.scratch(spark, "bronze")
    for batch_id in ("b1", "b1", "b2"):
        files.write_batch(_batch(spark, folder, batch_id), path)
    landed = files.read_table(spark, path)
    return landed.groupBy("_batch_id").agg(F.count(F.lit(1)).alias("batch_rows"), F.count_distinct("TransactionID").alias("ids"))


@query("src4_file_ledger", f"""WITH {RAW}, n AS (SELECT count(*) AS rows FROM raw) SELECT 'b1' AS _batch_id, rows AS batch_rows FROM n UNION ALL SELECT 'b3', rows FROM n""")
def src4_ledger(spark, folder):
    """A batch, run twice; its file under a second batch id, which lands nothing; the file with one more, of the same rows under another header order, which lands that one."""
    root = files.scratch(spark, "ledger")
    raw = tables.raw_transactions(spark, folder)
    raw.write.option("header", True).csv(f"{root}/in")
    for batch_id in ("b1", "b1", "b2"):
        medallion.bronze(spark, f"{root}/in", None, root, batch_id)
    raw.select(*reversed(raw.columns)).write.mode("append").option("header", True).csv(f"{root}/in")
    medallion.bronze(spark, f"{root}/in", None, root, "b3")
    return files.read_table(spark, f"{root}/bronze/transactions").groupBy("_batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))


@query("src5_optional_identity", f"""WITH {CLEAN} SELECT transaction_id, account_id, 'na:na' AS device_id, merchant_id,
false AS has_identity FROM cleaned""")
def src5(spark, folder):
    identity = files.read_optional(spark, f"{folder}/no-such-identity.parquet", RAW_IDENTITY)
    cleaned = cleaning.clean(tables.raw_transactions(spark, folder), identity)
    return cleaned.select("transaction_id", "account_id", "device_id", "merchant_id", "has_identity")


@query("src6_partition_overwrite", f"""WITH {TX} SELECT device_id, count(*) AS tx_count, round(sum(amount), 4) AS amount
FROM tx GROUP BY device_id""")
def src6(spark, folder):
    """A second write of one partition replaces that partition only."""
    tx = tables.transactions(spark, folder).select("transaction_id", "amount", "device_id")
    path = files.scratch(spark, "tx")
    files.write_table(tx, path, partition_by=["device_id"])
    files.write_table(tx.where(F.col("device_id") == "error"), path, partition_by=["device_id"])
    written = files.read_table(spark, path)
    return written.groupBy("device_id").agg(F.count(F.lit(1)).alias("tx_count"), F.round(F.sum("amount"), 4).alias("amount"))


@query("src7_merged_schema_read", f"""WITH {TX} SELECT transaction_id, amount, CASE WHEN is_fraud = 1 THEN merchant_id END AS merchant_id
FROM tx""")
def src7(spark, folder):
    """Two appends, of which one has a column more."""
    tx = tables.transactions(spark, folder)
    path = files.scratch(spark, "evolving")
    files.write_table(tx.where("is_fraud = 0").select("transaction_id", "amount"), path, "append")
    files.write_table(tx.where("is_fraud = 1").select("transaction_id", "amount", "merchant_id"), path, "append")
    return files.read_table(spark, path).select("transaction_id", "amount", "merchant_id")


@query("src9_fact_by_date", f"""WITH {TX} SELECT CAST(strftime(event_ts, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS tx_count,
sum(is_fraud)::BIGINT AS fraud_count FROM tx GROUP BY 1""")
def src9(spark, folder):
    tx = tables.transactions(spark, folder).withColumn("date_key", star.date_key())
    path = files.scratch(spark, "fact")
    files.write_table(tx.repartition("date_key", F.pmod(F.xxhash64("transaction_id"), F.lit(8))), path, partition_by=["date_key"])
    return files.read_table(spark, path).groupBy("date_key").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("is_fraud").alias("fraud_count"))


TRAINING_SQL = f"""WITH {FEATURES} SELECT tx_count_5m::DOUBLE AS tx_count_5m, tx_count_1h::DOUBLE AS tx_count_1h,
tx_count_24h::DOUBLE AS tx_count_24h, round(avg_amount_1h, 6) AS avg_amount_1h, amount,
unique_merchants_1h::DOUBLE AS unique_merchants_1h, device_shift::DOUBLE AS device_shift,
round(amount_zscore, 6) AS amount_zscore, is_fraud AS "isFraud" FROM ft"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("avg_amount_1h", "amount_zscore")})


def _fact(spark, folder):
    return star.fact(features.behaviour(tables.transactions(spark, folder)))


@query("src10_training_export", TRAINING_SQL)
def src10(spark, folder):
    path = files.scratch(spark, "export")
    files.export_training(star.training_set(_fact(spark, folder)), path)
    return _rounded(spark.read.parquet(f"{path}/training_parquet"))


@query("src11_export_manifest", "SELECT count(*) AS n_rows, 9 AS n_columns FROM events")
def src11(spark, folder):
    path = files.scratch(spark, "export")
    training = tables.transactions(spark, folder).select(
        *[F.lit(0).alias(c) for c in ("tx_count_5m", "tx_count_1h", "tx_count_24h", "avg_amount_1h", "unique_merchants_1h",
                                      "device_shift", "amount_zscore")], "amount", F.col("is_fraud").alias("isFraud"))
    files.export_training(star.training_set(training), path)
    manifest = spark.read.json(f"{path}/manifest")
    return manifest.select(F.col("rows").alias("n_rows"), F.size("columns").alias("n_columns"))


@query("src12_scoring_csv", f"""WITH {TX} SELECT transaction_id::VARCHAR AS transaction_id, account_id AS entity_id,
CASE WHEN amount < 1 THEN 0.0 ELSE amount END AS amount, 0 AS device_shift, 1::BIGINT AS tx_count_5m,
CASE WHEN amount < 1 THEN 0.0 ELSE amount END AS sum_amount_1h FROM tx""")
def src12(spark, folder):
    """Odd header spelling, unreadable amounts, and none of the optional columns."""
    tx = tables.transactions(spark, folder)
    path = files.scratch(spark, "upload")
    tx.select(F.col("transaction_id").alias(" Transaction_ID"), F.col("account_id").alias("ENTITY_ID "),
              F.when(F.col("amount") < 1, "unknown").otherwise(F.col("amount").cast("string")).alias("Amount"),
              ).write.option("header", True).csv(path)
    return files.read_scoring_csv(spark, path).select(
        "transaction_id", "entity_id", "amount", "device_shift", "tx_count_5m", "sum_amount_1h")


@query("src13_alert_csv_export", f"""WITH {PLAIN_ALERTS} SELECT id::VARCHAR AS transaction_id, entity_id,
risk_score::DOUBLE::VARCHAR AS risk_score, risk_label, status FROM pa""")
def src13(spark, folder):
    path = files.scratch(spark, "alerts-csv")
    files.export_alerts(tables.plain_alerts(spark, folder), path)
    return spark.read.option("header", True).csv(path).select("transaction_id", "entity_id", "risk_score", "risk_label", "status")


@query("src19_first_rows", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100")
def src19(spark, folder):
    return files.first_rows(tables.table(spark, folder, "events"), "event_id", 100).select("event_id", "user_id", "value")


# ---------------------------------------------------------------- cleaning

@query("prj1_enforce_types", f"""WITH {TYPED} SELECT transaction_id, event_time_seconds, amount, account_source, is_fraud FROM typed""")
def prj1(spark, folder):
    typed = cleaning.enforce_types(tables.raw_transactions(spark, folder))
    return typed.select("transaction_id", "event_time_seconds", "amount", "account_source", "is_fraud")


@query("prj2_normalise", f"""WITH {RAW} SELECT "TransactionID", lower(trim("P_emaildomain")) AS merchant_source FROM raw""")
def prj2(spark, folder):
    raw = tables.raw_transactions(spark, folder)
    return raw.select("TransactionID", cleaning.normal("P_emaildomain").alias("merchant_source"))


@query("prj3_incomplete_rows", f"""WITH {TYPED} SELECT count(*) AS total_rows,
(count(*) FILTER (WHERE transaction_id IS NULL OR amount IS NULL OR event_time_seconds IS NULL)) AS dropped_rows FROM typed""")
def prj3(spark, folder):
    typed = cleaning.enforce_types(tables.raw_transactions(spark, folder))
    return typed.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~cleaning.complete()).alias("dropped_rows"))


@query("prj4_canonical_entities", f"WITH {CLEAN} SELECT {', '.join(CLEAN_COLUMNS)} FROM cleaned")
def prj4(spark, folder):
    cleaned = cleaning.clean(tables.raw_transactions(spark, folder), tables.raw_identity(spark, folder))
    return tables.ntz(cleaned, "event_ts")


@query("jon1_identity_join", f"WITH {CLEAN} SELECT transaction_id, device_id, has_identity, identity_matched FROM cleaned")
def jon1(spark, folder):
    tx = cleaning.deduplicate(cleaning.drop_incomplete(cleaning.enforce_types(tables.raw_transactions(spark, folder))))
    joined = cleaning.entities(cleaning.join_identity(tx, tables.raw_identity(spark, folder)))
    return joined.select("transaction_id", "device_id", "has_identity", "identity_matched")


ORPHANS = f"""WITH {CLEAN} SELECT i.transaction_id, device_type FROM idn i
WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.transaction_id = i.transaction_id)"""


@query("jon2_orphan_identities", ORPHANS)
def jon2(spark, folder):
    tx = cleaning.drop_incomplete(cleaning.enforce_types(tables.raw_transactions(spark, folder)))
    return cleaning.orphans(tx, tables.raw_identity(spark, folder)).select("transaction_id", "device_type")


@query("set1_deduplicate", f"WITH {CLEAN} SELECT transaction_id, amount, account_source, is_fraud FROM good")
def set1(spark, folder):
    tx = cleaning.deduplicate(cleaning.drop_incomplete(cleaning.enforce_types(tables.raw_transactions(spark, folder))))
    return tx.select("transaction_id", "amount", "account_source", "is_fraud")


# ---------------------------------------------------------------- quality

NULLS = f"""WITH {RAW}, named AS (SELECT "TransactionID" AS transaction_id, "TransactionDT" AS event_time_seconds,
"TransactionAmt" AS amount, card1 AS account_source, "P_emaildomain" AS merchant_source, "isFraud" AS is_fraud FROM raw),
long AS (UNPIVOT (SELECT coalesce(transaction_id, '') AS transaction_id, coalesce(event_time_seconds, '') AS event_time_seconds,
coalesce(amount, '') AS amount, coalesce(account_source, '') AS account_source, coalesce(merchant_source, '') AS merchant_source,
coalesce(is_fraud, '') AS is_fraud FROM named) ON COLUMNS(*) INTO NAME column_name VALUE v),
rates AS (SELECT column_name, round(avg(CASE WHEN trim(v) = '' THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM long GROUP BY 1)"""
WATCHED = ["transaction_id", "event_time_seconds", "amount", "account_source", "merchant_source", "is_fraud"]


def _rates(spark, folder):
    return quality.null_rates(quality.canonical(tables.raw_transactions(spark, folder)).select(*WATCHED))


@query("dq1_null_rates", f"{NULLS} SELECT column_name, null_rate FROM rates")
def dq1(spark, folder):
    return _rates(spark, folder)


@query("dq2_null_breaches", f"""{NULLS} SELECT column_name, null_rate, CASE column_name WHEN 'account_source' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS bound
FROM rates WHERE column_name IN ('transaction_id', 'amount', 'event_time_seconds', 'account_source')
AND null_rate > CASE column_name WHEN 'account_source' THEN 0.02 ELSE 0.0 END""")
def dq2(spark, folder):
    return quality.null_breaches(_rates(spark, folder))


@query("dq3_duplicate_rate", f"""WITH {TYPED} SELECT round((count(transaction_id) - count(DISTINCT transaction_id))::DOUBLE / count(*), 6)
AS duplicate_rate FROM typed""")
def dq3(spark, folder):
    return quality.duplicate_rate(cleaning.enforce_types(tables.raw_transactions(spark, folder)))


@query("dq4_reconciliation", f"""WITH {CLEAN} SELECT 'b1' AS _batch_id, (SELECT count(*) FROM raw) AS bronze_rows,
(SELECT count(*) FROM good) AS silver_rows,
round(((SELECT count(*) FROM raw) - (SELECT count(*) FROM good))::DOUBLE / (SELECT count(*) FROM raw), 6) AS shrink""")
def dq4(spark, folder):
    return quality.reconcile(_batch(spark, folder))


DRIFT_SQL = """SELECT column_name, 'new' AS change FROM (SELECT column_name FROM (DESCRIBE events)
EXCEPT SELECT unnest(['event_id', 'ts', 'user_id', 'amount', 'channel']))
UNION ALL SELECT column_name, 'missing' FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'amount', 'channel']) AS column_name
EXCEPT SELECT column_name FROM (DESCRIBE events))"""


def _drift(spark, folder):
    drift = quality.schema_drift(tables.table(spark, folder, "events"), ["event_id", "ts", "user_id", "amount", "channel"])
    rows = [(c, change) for change, columns in drift.items() for c in columns]
    return spark.createDataFrame(rows, "column_name string, change string")


@query("dq5_schema_drift", DRIFT_SQL)
def dq5(spark, folder):
    return _drift(spark, folder)


@query("set2_column_difference", DRIFT_SQL)
def set2(spark, folder):
    return _drift(spark, folder)


@query("dq6_orphan_count", f"SELECT count(*) AS orphan_identity_rows FROM ({ORPHANS})")
def dq6(spark, folder):
    return jon2(spark, folder).agg(F.count(F.lit(1)).alias("orphan_identity_rows"))


def _report(spark, folder, batch_id="b1", day=1):
    return quality.assess(_batch(spark, folder, batch_id), tables.raw_identity(spark, folder), batch_id,
                          datetime.datetime(2024, 6, day, tzinfo=datetime.UTC), RAW_TRANSACTION.names)


REPORT_SQL = f"""WITH {CLEAN}, n AS (SELECT (SELECT count(*) FROM raw) AS bronze_rows, (SELECT count(*) FROM good) AS silver_rows,
(SELECT count(*) FROM idn i WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.transaction_id = i.transaction_id)) AS orphan_identity_rows,
(SELECT round((count(transaction_id) - count(DISTINCT transaction_id))::DOUBLE / count(*), 6) FROM typed) AS duplicate_rate)"""


@query("dq7_report", f"""{REPORT_SQL} SELECT 'b1' AS batch_id, TIMESTAMP '2024-06-01' AS checked_at, bronze_rows, silver_rows,
round((bronze_rows - silver_rows)::DOUBLE / bronze_rows, 6) AS rowcount_shrink_rate, duplicate_rate, orphan_identity_rows,
false AS drift_detected, false AS passed FROM n""")
def dq7(spark, folder):
    path = files.scratch(spark, "dq")
    files.write_table(quality.flat_report(_report(spark, folder)), path, "append")
    report = files.read_table(spark, path)
    return tables.ntz(report.drop("null_rates_json", "schema_drift_json", "failures_json"), "checked_at")


@query("dq8_gate")
def dq8(spark, folder):
    """Blank amounts exceed their bound, so the gate must refuse the batch and say why."""
    try:
        quality.gate(_report(spark, folder))
        return spark.createDataFrame([("published", "")], "outcome string, reason string")
    except quality.QualityFailure as failure:
        return spark.createDataFrame([("refused", str(failure))], "outcome string, reason string")


@query("dq9_latest_run", f"""{REPORT_SQL} SELECT 'b2' AS batch_id, bronze_rows, silver_rows, false AS passed, 2::BIGINT AS runs FROM n""")
def dq9(spark, folder):
    history = _report(spark, folder, "b1", 1).unionByName(_report(spark, folder, "b2", 2))
    return quality.latest_report(history)


@query("top8_null_rate_columns", f"{NULLS} SELECT column_name, null_rate FROM rates ORDER BY null_rate DESC, column_name LIMIT 12")
def top8(spark, folder):
    return quality.top_null_rates(_rates(spark, folder))


# ---------------------------------------------------------------- star schema

@query("agg1_dim_account", f"""WITH {TX} SELECT account_id, min(event_ts) AS first_seen, max(event_ts) AS last_seen, count(*) AS tx_count,
sum(is_fraud)::BIGINT AS fraud_count, count(DISTINCT device_id) AS distinct_devices, round(avg(amount), 8) AS avg_amount,
round(sum(is_fraud)::DOUBLE / count(*), 4) AS fraud_rate FROM tx GROUP BY account_id""")
def agg1(spark, folder):
    out = star.dim_account(tables.transactions(spark, folder))
    return tables.ntz(out, "first_seen", "last_seen").withColumn("avg_amount", F.round("avg_amount", 8))


@query("agg2_dim_device", f"""WITH {TX} SELECT device_id, count(*) AS tx_count, count(DISTINCT account_id) AS distinct_accounts,
sum(is_fraud)::BIGINT AS fraud_count FROM tx GROUP BY device_id""")
def agg2(spark, folder):
    return star.dim_device(tables.transactions(spark, folder))


@query("agg3_dim_date", f"""WITH {TX} SELECT DISTINCT CAST(strftime(event_ts, '%Y%m%d') AS INTEGER) AS date_key, year(event_ts) AS year,
month(event_ts) AS month, day(event_ts) AS day, dayofweek(event_ts) + 1 AS day_of_week,
CAST(dayofweek(event_ts) IN (0, 6) AS INTEGER) AS is_weekend FROM tx""")
def agg3(spark, folder):
    return star.dim_date(tables.transactions(spark, folder))


FACT_SQL = f"""WITH {FEATURES} SELECT transaction_id, account_id, device_id, merchant_id,
CAST(strftime(event_ts, '%Y%m%d') AS INTEGER) AS date_key, amount, event_ts, tx_count_5m, tx_count_1h, tx_count_24h,
round(avg_amount_1h, 6) AS avg_amount_1h, unique_merchants_1h, device_shift, round(amount_zscore, 6) AS amount_zscore,
is_fraud AS "isFraud" FROM ft"""


@query("fact_transactions", FACT_SQL)
def fact(spark, folder):
    return tables.ntz(_rounded(_fact(spark, folder)), "event_ts")


@query("job1_incremental_fact", FACT_SQL)
def incremental_fact(spark, folder):
    """The fact table of three batches one after the other: the first half in time, the rest, and every seventeenth row late."""
    root, tx = files.scratch(spark, "increments"), tables.transactions(spark, folder)
    middle = tx.agg(((F.min("event_time_seconds") + F.max("event_time_seconds")) / 2).alias("t")).first().t or 0.0
    batch = F.when(F.col("transaction_id") % 17 == 0, "b3").when(F.col("event_time_seconds") < middle, "b1").otherwise("b2")
    files.write_batch(tx.withColumn("_batch_id", batch), f"{root}/in")
    for name in ("b1", "b2", "b3"):
        one = spark.read.parquet(f"{root}/in").where(F.col("_batch_id") == name)
        files.write_batch(one, f"{root}/silver/transactions_cleaned")
        medallion.gold(spark, root, batch_id=name)
    out = spark.read.parquet(f"{root}/gold/fact_transactions")
    return tables.ntz(_rounded(out), "event_ts")


@query("flagship_account_risk", f"""WITH {FEATURES} SELECT account_id, count(*) AS tx_count, sum(is_fraud)::BIGINT AS fraud_count,
max(tx_count_5m) AS peak_5m, max(tx_count_24h) AS peak_24h, sum(device_shift)::BIGINT AS device_shifts,
round(max(sum_amount_1h), 4) AS peak_amount_1h, round(max(abs(amount_zscore)), 6) AS peak_zscore,
(count(*) FILTER (WHERE device_shift = 1 OR amount > 2000)) AS flagged FROM ft GROUP BY account_id""")
def flagship(spark, folder):
    featured = features.behaviour(tables.transactions(spark, folder))
    return featured.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("is_fraud").alias("fraud_count"), F.max("tx_count_5m").alias("peak_5m"),
        F.max("tx_count_24h").alias("peak_24h"), F.sum("device_shift").alias("device_shifts"),
        F.round(F.max("sum_amount_1h"), 4).alias("peak_amount_1h"),
        F.round(F.max(F.abs("amount_zscore")), 6).alias("peak_zscore"),
        F.count_if((F.col("device_shift") == 1) | (F.col("amount") > 2000)).alias("flagged"))


# ---------------------------------------------------------------- the whole job

JOB_TX = f"""WITH {CLEAN.replace("CASE WHEN value < 0.5 THEN '' WHEN value < 0.7 THEN 'n/a' ELSE CAST(value AS VARCHAR) END",
                                 "CAST(value AS VARCHAR)")}, j AS (SELECT *, CAST(event_time_seconds AS BIGINT) AS t FROM cleaned)"""


@query("job1_medallion", f"""{JOB_TX} SELECT (SELECT count(*) FROM raw) AS bronze_rows, (SELECT count(*) FROM j) AS silver_rows,
(SELECT count(*) FROM j) AS fact_rows, (SELECT count(DISTINCT account_id) FROM j) AS accounts,
(SELECT count(DISTINCT device_id) FROM j) AS devices, (SELECT count(DISTINCT CAST(event_ts AS DATE)) FROM j) AS dates,
(SELECT count(*) FROM j WHERE is_fraud = 1) AS fraud_rows, (SELECT count(*) FROM j) AS exported_rows""")
def job1(spark, folder):
    """All stages over files. Amounts are repaired first, because the dirty batch is refused by the gate."""
    root = files.scratch(spark, "medallion")
    raw = tables.raw_transactions(spark, folder).drop("TransactionAmt").join(
        tables.table(spark, folder, "events").select(
            F.col("event_id").cast("string").alias("TransactionID"), F.col("value").cast("string").alias("TransactionAmt")),
        "TransactionID")
    raw.select(*RAW_TRANSACTION.names).write.option("header", True).csv(f"{root}/in/transactions")
    tables.raw_identity(spark, folder).write.option("header", True).csv(f"{root}/in/identity")
    medallion.run(spark, f"{root}/in/transactions", f"{root}/in/identity", root, "b1")
    count = lambda name: files.read_table(spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("n"))
    fact_table = files.read_table(spark, f"{root}/gold/fact_transactions")
    row = fact_table.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("isFraud") == 1).alias("fraud")).first()
    numbers = [(count("bronze/transactions").first().n, count("silver/transactions_cleaned").first().n, row.n,
                count("gold/dim_account").first().n, count("gold/dim_device").first().n, count("gold/dim_date").first().n,
                row.fraud, count("export/training_parquet").first().n)]
    return spark.createDataFrame(numbers, "bronze_rows long, silver_rows long, fact_rows long, accounts long, devices long, "
                                          "dates long, fraud_rows long, exported_rows long")
