"""SQL text shared by the oracles: the same adapters as :mod:`riskloom.sources.tables`."""

TX = """tx AS (
  SELECT event_id AS transaction_id, CAST(user_id AS VARCHAR) AS account_id, event_type AS device_id,
         'm' || regexp_extract(props, '"k": *([0-9]+)', 1) AS merchant_id, value AS amount,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT) AS t, ts AS event_ts,
         CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS is_fraud,
         user_id
  FROM events)"""

PLAIN_ALERTS = TX + """,
pa AS (
  SELECT transaction_id AS id, event_ts AS created_at, transaction_id, account_id AS entity_id, device_id,
         merchant_id, amount, t, (transaction_id * 7919 % 1000) / 1000.0 AS risk_score,
         CASE WHEN (transaction_id * 7919 % 1000) / 1000.0 >= 0.2078 THEN 'FRAUD'
              WHEN (transaction_id * 7919 % 1000) / 1000.0 >= 0.2078 * 0.5 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS risk_label,
         ['open', 'investigating', 'resolved', 'dismissed'][transaction_id % 4 + 1] AS status, is_fraud
  FROM tx)"""

ALERTS = PLAIN_ALERTS + """,
al AS (
  SELECT *,
    count(*) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS tx_count_5m,
    count(*) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS tx_count_1h,
    count(*) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_count_24h,
    sum(amount) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS sum_amount_1h,
    CAST(coalesce(lag(device_id) OVER (PARTITION BY entity_id ORDER BY t, id) <> device_id, false) AS INTEGER) AS device_shift
  FROM pa)"""

FEATURES = TX + """,
ft AS (
  SELECT *,
    count(*) OVER w5 AS tx_count_5m, count(*) OVER w1 AS tx_count_1h, count(*) OVER w24 AS tx_count_24h,
    sum(amount) OVER w1 AS sum_amount_1h, sum(amount) OVER w1 / count(*) OVER w1 AS avg_amount_1h,
    len(list_distinct(list(merchant_id) OVER w1)) AS unique_merchants_1h,
    CAST(coalesce(lag(device_id) OVER sq <> device_id, false) AS INTEGER) AS device_shift,
    CASE WHEN coalesce(stddev_samp(amount) OVER ex, 0) > 0
         THEN (amount - avg(amount) OVER ex) / stddev_samp(amount) OVER ex ELSE 0.0 END AS amount_zscore
  FROM tx
  WINDOW w5 AS (PARTITION BY account_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW),
         w1 AS (PARTITION BY account_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
         w24 AS (PARTITION BY account_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW),
         sq AS (PARTITION BY account_id ORDER BY t, transaction_id),
         ex AS (PARTITION BY account_id ORDER BY t, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

FEEDBACK = """fb AS (
  SELECT event_id * 2 + r AS id, event_id AS alert_id, ts + to_hours(CAST(r AS INTEGER)) AS created_at,
         CASE WHEN (event_id % 2 = 0) = (r = 1) THEN 'confirmed_fraud' ELSE 'false_positive' END AS label,
         'analyst' || (user_id % 5) AS analyst
  FROM events, (SELECT 1 AS r UNION ALL SELECT 2) WHERE event_type = 'purchase' AND (r = 1 OR value > 100))"""

LATEST_FEEDBACK = FEEDBACK + """,
lf AS (SELECT alert_id, arg_max(label, (created_at, id)) AS label FROM fb GROUP BY alert_id)"""

NOTES = """nt AS (
  SELECT event_id * 2 + r AS id, event_id AS alert_id, ts + to_minutes(CAST(r * 10 AS INTEGER)) AS created_at,
         'analyst' || (user_id % 5) AS author, 'note ' || r || ' on ' || event_id AS body
  FROM events, (SELECT 1 AS r UNION ALL SELECT 2) WHERE event_type = 'signup' AND (r = 1 OR value > 50))"""

AUDIT = """au AS (
  SELECT event_id AS id, event_id AS target_id, ts + INTERVAL 30 MINUTE AS created_at, user_id AS actor_id,
         'set_status:' || event_type AS action
  FROM events WHERE event_type = 'click'),
us AS (SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email FROM customer WHERE c_acctbal > 0)"""

RAW = """raw AS (
  SELECT CAST(event_id AS VARCHAR) AS "TransactionID",
         CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' AND value > 60 THEN '1' ELSE '0' END AS "isFraud",
         CAST(CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT) AS VARCHAR) AS "TransactionDT",
         CASE WHEN value < 0.5 THEN '' WHEN value < 0.7 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS "TransactionAmt",
         upper(substr(event_type, 1, 1)) AS "ProductCD",
         CASE WHEN regexp_extract(props, '"k": *([0-9]+)', 1) <> '7' THEN CAST(user_id AS VARCHAR) END AS card1,
         'visa' AS card4, 'debit' AS card6,
         CASE WHEN regexp_extract(props, '"k": *([0-9]+)', 1) <> '13'
              THEN ' M' || regexp_extract(props, '"k": *([0-9]+)', 1) || ' ' END AS "P_emaildomain",
         CAST(NULL AS VARCHAR) AS "R_emaildomain"
  FROM events, (SELECT 1 AS r UNION ALL SELECT 2) WHERE r = 1 OR value > 300)"""

IDENTITY = """ident AS (
  SELECT CAST(event_id AS VARCHAR) AS "TransactionID", upper(event_type) || ' ' AS "DeviceType",
         CASE WHEN regexp_extract(props, '"k": *([0-9]+)', 1) <> '5'
              THEN 'Info-' || right(regexp_extract(props, '"k": *([0-9]+)', 1), 1) END AS "DeviceInfo"
  FROM events WHERE event_type <> 'view'
  UNION ALL
  SELECT CAST(c_custkey + 999000000000 AS VARCHAR), 'MOBILE', 'Info-x' FROM customer WHERE c_acctbal < 0)"""

TYPED = RAW + """,
typed AS (
  SELECT TRY_CAST("TransactionID" AS BIGINT) AS transaction_id, TRY_CAST("TransactionDT" AS DOUBLE) AS event_time_seconds,
         TRY_CAST("TransactionAmt" AS DOUBLE) AS amount, card1 AS account_source,
         lower(trim("P_emaildomain")) AS merchant_source, coalesce(TRY_CAST("isFraud" AS INTEGER), 0) AS is_fraud
  FROM raw)"""

CLEAN = TYPED + ", " + IDENTITY + """,
good AS (SELECT DISTINCT * FROM typed WHERE transaction_id IS NOT NULL AND amount IS NOT NULL AND event_time_seconds IS NOT NULL),
idn AS (SELECT DISTINCT TRY_CAST("TransactionID" AS BIGINT) AS transaction_id, lower(trim("DeviceType")) AS device_type,
               lower(trim("DeviceInfo")) AS device_info FROM ident),
cleaned AS (
  SELECT g.transaction_id, coalesce(account_source, 'unknown') AS account_id,
         coalesce(device_type, 'na') || ':' || coalesce(device_info, 'na') AS device_id,
         coalesce(merchant_source, 'unknown') AS merchant_id, amount, event_time_seconds,
         TIMESTAMP '1970-01-01' + to_seconds(event_time_seconds) AS event_ts, is_fraud,
         device_info IS NOT NULL AS has_identity, i.transaction_id IS NOT NULL AS identity_matched
  FROM good g LEFT JOIN idn i USING (transaction_id))"""
