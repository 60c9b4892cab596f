"""Velocity windows, shifts, z-scores and bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import FEATURES, LATEST_FEEDBACK, PLAIN_ALERTS, TX
from riskloom.operators import features, ranking
from riskloom.operators.ordered import HOT_ROWS
from riskloom.sources import tables

W = "PARTITION BY account_id ORDER BY t RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
SEQ = "PARTITION BY account_id ORDER BY t, transaction_id"


@query("win1_velocity_counts", f"""WITH {TX}
SELECT transaction_id, count(*) OVER ({W.format(300)}) AS tx_count_5m, count(*) OVER ({W.format(3600)}) AS tx_count_1h,
       count(*) OVER ({W.format(86400)}) AS tx_count_24h FROM tx""")
def win1(spark, folder):
    out = features.velocity(tables.transactions(spark, folder))
    return out.select("transaction_id", "tx_count_5m", "tx_count_1h", "tx_count_24h")


LATER = f"(count(*) OVER (PARTITION BY account_id, t) - row_number() OVER (PARTITION BY account_id, t ORDER BY transaction_id))"


@query("win2_velocity_left_open", f"""WITH {TX}
SELECT transaction_id, count(*) OVER ({W.format(299)}) - {LATER} AS tx_count_5m,
       count(*) OVER ({W.format(3599)}) - {LATER} AS tx_count_1h,
       count(*) OVER ({W.format(86399)}) - {LATER} AS tx_count_24h FROM tx""")
def win2(spark, folder):
    out = features.velocity(tables.transactions(spark, folder), boundary="left_open")
    return out.select("transaction_id", "tx_count_5m", "tx_count_1h", "tx_count_24h")


WIN3 = f"""WITH {TX}
SELECT transaction_id, round(sum(amount) OVER ({W.format(3600)}), 6) AS sum_amount_1h,
       round(sum(amount) OVER ({W.format(3600)}) / count(*) OVER ({W.format(3600)}), 6) AS avg_amount_1h FROM tx"""


@query("win3_amount_1h", WIN3)
def win3(spark, folder, hot_rows=HOT_ROWS):
    out = features.amount_1h(tables.transactions(spark, folder), hot_rows=hot_rows)
    return out.select("transaction_id", F.round("sum_amount_1h", 6).alias("sum_amount_1h"),
                      F.round("avg_amount_1h", 6).alias("avg_amount_1h"))


@query("win3_amount_1h_sliced", WIN3)
def win3_sliced(spark, folder):
    """Every account as a hot one."""
    return win3(spark, folder, 0)


@query("win3_exact_sums", f"""WITH {TX}, far AS (SELECT *, CASE transaction_id % 4 WHEN 0 THEN 1e19::DOUBLE WHEN 1 THEN -1e19::DOUBLE WHEN 2 THEN 3e-11::DOUBLE ELSE amount END AS x FROM tx),
n AS (SELECT transaction_id, count(*) FILTER (WHERE x = 1e19::DOUBLE) OVER w - count(*) FILTER (WHERE x = -1e19::DOUBLE) OVER w AS large,
  coalesce(sum(round(x * 100)::HUGEINT) FILTER (WHERE transaction_id % 4 = 3) OVER w, 0) AS cents, count(*) FILTER (WHERE x = 3e-11::DOUBLE) OVER w AS small FROM far WINDOW w AS ({W.format(3600)}))
SELECT transaction_id, large, round((cents * 1000000000 + small * 3) / 1e11::DOUBLE, 9) AS rest FROM n""")
def win3_exact(spark, folder):
    """Amounts of 1e19, -1e19, 3e-11 and between: what is left of a sum less its large amounts has all its digits, as only an exact sum has. Every account is hot."""
    far = F.when(F.col("transaction_id") % 4 == 0, 1e19).when(F.col("transaction_id") % 4 == 1, -1e19).when(F.col("transaction_id") % 4 == 2, 3e-11).otherwise(F.col("amount"))
    tx = tables.transactions(spark, folder).withColumn("amount", far)
    whole = features.amount_1h(tx, hot_rows=0)
    large = F.when(F.abs("amount") == 1e19, F.signum("amount")).otherwise(0.0)
    less = features.amount_1h(whole.drop("sum_amount_1h", "avg_amount_1h").withColumn("amount", F.when(large != 0, 0.0).otherwise(F.col("amount"))), hot_rows=0)
    counts = features.amount_1h(tx.withColumn("amount", large), hot_rows=0).select("transaction_id", F.col("sum_amount_1h").cast("long").alias("large"))
    exact = whole.select("transaction_id", F.col("sum_amount_1h").alias("whole")).join(counts, "transaction_id")
    out = exact.join(less.select("transaction_id", F.col("sum_amount_1h").alias("rest")), "transaction_id")
    wrong = F.when((F.col("large") == 0) & (F.col("whole") != F.col("rest")), F.lit(float("nan"))).otherwise(F.col("rest"))
    return out.select("transaction_id", "large", F.round(wrong, 9).alias("rest"))


@query("win4_distinct_merchants", f"""WITH {TX}
SELECT transaction_id, len(list_distinct(list(merchant_id) OVER ({W.format(3600)}))) AS unique_merchants_1h FROM tx""")
def win4(spark, folder):
    out = features.distinct_merchants(tables.transactions(spark, folder))
    return out.select("transaction_id", "unique_merchants_1h")


CATEGORIES = ["signup", "click", "error", "purchase", "view"]


@query("win5_category_presence", f"""WITH {TX},
pairs AS (
  SELECT a.transaction_id, count(DISTINCT b.device_id) AS category_count_1h
  FROM tx a JOIN tx b ON a.account_id = b.account_id AND b.t > a.t - 3600
       AND (b.t < a.t OR (b.t = a.t AND b.transaction_id <= a.transaction_id))
  GROUP BY a.transaction_id)
SELECT transaction_id, category_count_1h FROM pairs""")
def win5(spark, folder):
    out = features.category_presence(tables.transactions(spark, folder), CATEGORIES)
    return out.select("transaction_id", "category_count_1h")


@query("win6_device_shift_lag", f"""WITH {TX}
SELECT transaction_id, CAST(coalesce(lag(device_id) OVER ({SEQ}) <> device_id, false) AS INTEGER) AS device_shift FROM tx""")
def win6(spark, folder):
    return features.device_shift(tables.transactions(spark, folder)).select("transaction_id", "device_shift")


@query("win7_device_shift_within", f"""WITH {TX}
SELECT transaction_id, CAST(coalesce(lag(device_id) OVER ({SEQ}) <> device_id AND t - lag(t) OVER ({SEQ}) <= 1800, false)
       AS INTEGER) AS device_shift FROM tx""")
def win7(spark, folder):
    out = features.device_shift(tables.transactions(spark, folder), mode="lag_within")
    return out.select("transaction_id", "device_shift")


@query("win8_device_shift_sticky", f"""WITH {TX},
steps AS (SELECT *, CASE WHEN lag(device_id) OVER ({SEQ}) <> device_id AND t - lag(t) OVER ({SEQ}) < 86400 THEN t END AS changed
          FROM tx)
SELECT transaction_id, CAST(coalesce(t - last_value(changed IGNORE NULLS) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW) < 1800, false) AS INTEGER) AS device_shift FROM steps""")
def win8(spark, folder):
    out = features.device_shift(tables.transactions(spark, folder), mode="sticky")
    return out.select("transaction_id", "device_shift")


@query("win9_zscore_expanding", f"""WITH {FEATURES}
SELECT transaction_id, round(amount_zscore, 6) AS amount_zscore FROM ft""")
def win9(spark, folder):
    out = features.amount_zscore(tables.transactions(spark, folder))
    return out.select("transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"))


WIN10 = f"""WITH {TX.replace(
    "CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT)", "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)")}
SELECT transaction_id, round(CASE WHEN coalesce(stddev_samp(amount) OVER r, 0) > 0
       THEN (amount - avg(amount) OVER r) / stddev_samp(amount) OVER r ELSE 0.0 END, 6) AS amount_zscore
FROM tx WINDOW r AS ({W.format(864000)})"""


@query("win10_zscore_rolling_30d", WIN10)
def win10(spark, folder, hot_rows=HOT_ROWS):
    """Ten days on the real clock: the tables span thirty, so a 30-day frame would never slide."""
    out = features.amount_zscore(tables.transactions(spark, folder, clock="real"), mode="rolling_30d", window=864000, hot_rows=hot_rows)
    return out.select("transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"))


@query("win10_zscore_sliced", WIN10)
def win10_sliced(spark, folder):
    """Every account as a hot one."""
    return win10(spark, folder, 0)


def _burst_sql(width: int, value: str, name: str) -> str:
    return f"""WITH {TX},
marked AS (SELECT *, CASE WHEN lag(t) OVER ({SEQ}) IS NULL OR t - lag(t) OVER ({SEQ}) >= {width} THEN 1 ELSE 0 END AS s FROM tx),
sessioned AS (SELECT *, sum(s) OVER ({SEQ} ROWS UNBOUNDED PRECEDING) AS n FROM marked)
SELECT transaction_id, {value} OVER (PARTITION BY account_id, n ORDER BY t, transaction_id ROWS UNBOUNDED PRECEDING) AS {name}
FROM sessioned"""


@query("win11_burst_counts", f"""SELECT * FROM ({_burst_sql(300, 'count(*)', 'burst_count_5m')})
JOIN ({_burst_sql(3600, 'count(*)', 'burst_count_1h')}) USING (transaction_id)
JOIN ({_burst_sql(86400, 'count(*)', 'burst_count_24h')}) USING (transaction_id)
JOIN (SELECT transaction_id, round(burst_sum_1h, 6) AS burst_sum_1h
      FROM ({_burst_sql(3600, 'sum(amount)', 'burst_sum_1h')})) USING (transaction_id)""")
def win11(spark, folder):
    out = features.bursts(tables.transactions(spark, folder))
    return out.select("transaction_id", "burst_count_5m", "burst_count_1h", "burst_count_24h",
                      F.round("burst_sum_1h", 6).alias("burst_sum_1h"))


@query("win12_zscore_gap_reset", f"""WITH {TX},
marked AS (SELECT *, CASE WHEN lag(t) OVER ({SEQ}) IS NULL OR t - lag(t) OVER ({SEQ}) >= 1800 THEN 1 ELSE 0 END AS s FROM tx),
sessioned AS (SELECT *, sum(s) OVER ({SEQ} ROWS UNBOUNDED PRECEDING) AS n FROM marked)
SELECT transaction_id, round(CASE WHEN coalesce(stddev_samp(amount) OVER x, 0) > 0
       THEN (amount - avg(amount) OVER x) / stddev_samp(amount) OVER x ELSE 0.0 END, 6) AS amount_zscore
FROM sessioned WINDOW x AS (PARTITION BY account_id, n ORDER BY t, transaction_id ROWS UNBOUNDED PRECEDING)""")
def win12(spark, folder):
    """A gap of 1800 fast-clock seconds, so that resets happen inside the table's span."""
    out = features.amount_zscore(tables.transactions(spark, folder), mode="gap_reset_30d", window=1800)
    return out.select("transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"))


@query("win13_latest_per_key", f"""WITH {LATEST_FEEDBACK} SELECT alert_id, label FROM lf""")
def win13(spark, folder):
    latest = ranking.latest(tables.feedback(spark, folder), ["alert_id"], ["created_at", "id"])
    return latest.select("alert_id", "label")


@query("win14_chronological_split", f"""WITH {TX}
SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY t, transaction_id) <= (SELECT count(*) * 8 // 10 FROM tx)
       THEN 'train' ELSE 'validation' END AS part FROM tx""")
def win14(spark, folder):
    out = ranking.chronological_split(tables.transactions(spark, folder), ["event_time_seconds", "transaction_id"], 0.8)
    return out.select("transaction_id", "part")


@query("win15_recent_half", f"""WITH {PLAIN_ALERTS}
SELECT id, CASE WHEN row_number() OVER (ORDER BY created_at DESC, id DESC) <= (SELECT count(*) // 2 FROM pa)
       THEN 'recent' ELSE 'base' END AS half FROM pa""")
def win15(spark, folder):
    return ranking.halves(tables.plain_alerts(spark, folder), "created_at", "id").select("id", "half")


@query("prj13_calendar", f"""WITH {TX} SELECT transaction_id, hour(event_ts) AS hour_of_day,
       CAST(dayofweek(event_ts) IN (0, 6) AS INTEGER) AS is_weekend FROM tx""")
def prj13(spark, folder):
    out = features.calendar(tables.transactions(spark, folder))
    return out.select("transaction_id", "hour_of_day", "is_weekend")
