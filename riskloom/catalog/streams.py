"""Streaming queries: the tables are replayed as files in time order and the results compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.analytics import CODES, _mod_sql, uuid5_sql
from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import ALERTS, FEEDBACK, PLAIN_ALERTS, TX
from riskloom.catalog.verdicts import NAMES_SQL, RULES, WATCH, WATCHED, watchlist
from riskloom.catalog.windows import LATER, SEQ, W, _burst_sql
from riskloom.operators.decisions import match_watchlist
from riskloom.plans import analytics, live
from riskloom.sources import files, tables
from riskloom.streaming import events as stream
from riskloom.streaming import keyed, monitors, state


def _fast(spark, folder):
    """Transactions on the fast clock: event times and seconds agree, so watermarks and windows see the same time."""
    tx = tables.transactions(spark, folder).withColumnRenamed("account_id", "entity_id")
    return tx.withColumn("event_ts", F.timestamp_seconds(F.col("event_time_seconds") + tables.FAST_CLOCK_START))


def _replayed(df, order=("event_time_seconds", "transaction_id"), last=None):
    return stream.from_table(df.sparkSession, stream.replay(df, list(order), last=last), df.schema)


def _events(spark, folder):
    """All transactions in the order of their times up to half an hour's shuffle, then a row that moves the watermark past them."""
    rows = _fast(spark, folder)
    shuffled = F.col("event_time_seconds") + F.pmod(F.xxhash64("transaction_id"), F.lit(1800))
    return stream.from_table(spark, stream.replay(rows.withColumn("arrival", shuffled), ["arrival", "transaction_id"], last=stream.heartbeat(rows).withColumn("arrival", F.lit(None).cast("double"))),
                             rows.schema)


def _live(spark, folder):
    return stream.run(state.live_features(_events(spark, folder)))


# ---------------------------------------------------------------- parsing, sources and sinks

MESSAGES = """ok AS (SELECT event_id, user_id, value, event_type FROM events WHERE NOT (event_type = 'error' AND value < 5)
AND NOT (event_type = 'view' AND value < 5))"""


def _messages(spark, folder):
    """JSON lines: small errors are cut off in the middle, small views have no entity, and clicks carry a broken time."""
    rows = tables.table(spark, folder, "events")
    time = F.when(F.col("event_type") == "click", "yesterday").otherwise(F.date_format(tables.utc("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    entity = F.when((F.col("event_type") == "view") & (F.col("value") < 5), None).otherwise(F.col("user_id").cast("string"))
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("transaction_id"), entity.alias("entity_id"), F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").alias("merchant_id"), F.col("event_type").alias("device_fingerprint"), time.alias("timestamp")))
    broken = (F.col("event_type") == "error") & (F.col("value") < 5)
    return rows.select("event_id", F.when(broken, F.substring(body, 1, 30)).otherwise(body).alias("value"))


def _text_stream(spark, folder):
    return stream.from_text(spark, stream.replay(_messages(spark, folder), ["event_id"], text=True))


@query("str1_parse_and_skip", f"WITH {MESSAGES} SELECT event_id::VARCHAR AS transaction_id, user_id::VARCHAR AS entity_id, value AS amount FROM ok")
def str1(spark, folder):
    good, bad = files.scratch(spark, "good"), files.scratch(spark, "bad")
    parsed = stream.parse(_text_stream(spark, folder))
    stream.start(parsed, stream.route(parsed, good, bad)).awaitTermination()
    return spark.read.parquet(good).select("transaction_id", "entity_id", "amount")


@query("str1_rejected_messages", f"WITH {MESSAGES} SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM ok) AS rejected")
def str1_rejected(spark, folder):
    good, bad = files.scratch(spark, "good"), files.scratch(spark, "bad")
    parsed = stream.parse(_text_stream(spark, folder))
    stream.start(parsed, stream.route(parsed, good, bad)).awaitTermination()
    return spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("rejected"))


@query("src14_event_stream", f"""WITH {MESSAGES} SELECT event_id::VARCHAR AS transaction_id, event_type AS device_fingerprint,
CASE WHEN event_type = 'click' THEN NULL ELSE date_trunc('second', ts) END AS event_ts FROM ok JOIN events USING (event_id, event_type)""")
def src14(spark, folder):
    """Clicks take the arrival time, which is blanked here because it changes from run to run."""
    parsed = stream.parse(_text_stream(spark, folder)).where("valid").select("transaction_id", "device_fingerprint", "event_ts")
    out = stream.run(parsed).withColumn("event_ts", F.when(F.col("device_fingerprint") != "click", F.col("event_ts")))
    return tables.ntz(out, "event_ts")


@query("src15_feature_updates", f"WITH {TX} SELECT account_id AS entity_id, count(*) AS updates, 6 AS fields FROM tx GROUP BY account_id")
def src15(spark, folder):
    updates = stream.run(stream.feature_updates(state.live_features(_events(spark, folder))))
    return updates.groupBy("entity_id").agg(F.count(F.lit(1)).alias("updates"), F.max(F.size("updates_applied")).alias("fields"))


BURST = f"""{TX}, live AS (SELECT tx.*, c5.burst_count_5m AS tx_count_5m, c1.burst_count_1h AS tx_count_1h, c24.burst_count_24h AS tx_count_24h,
s1.burst_sum_1h AS sum_amount_1h, sh.device_shift FROM tx JOIN ({_burst_sql(300, 'count(*)', 'burst_count_5m')}) c5 USING (transaction_id)
JOIN ({_burst_sql(3600, 'count(*)', 'burst_count_1h')}) c1 USING (transaction_id) JOIN ({_burst_sql(86400, 'count(*)', 'burst_count_24h')}) c24 USING (transaction_id)
JOIN ({_burst_sql(3600, 'sum(amount)', 'burst_sum_1h')}) s1 USING (transaction_id) JOIN (SELECT transaction_id, CAST(coalesce(t - last_value(changed IGNORE NULLS)
OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 1800, false) AS INTEGER) AS device_shift FROM (SELECT *, CASE WHEN lag(device_id) OVER ({SEQ}) <> device_id
AND t - lag(t) OVER ({SEQ}) < 86400 THEN t END AS changed FROM tx)) sh USING (transaction_id)),
lv AS (SELECT *, transaction_id AS id, account_id AS entity_id, CASE WHEN device_shift = 1 OR amount > 2000 THEN 0.85::DOUBLE ELSE 0.05::DOUBLE END AS risk_score FROM live),
{WATCH}, {WATCHED.format('lv')},
verdicts AS (SELECT lv.*, {NAMES_SQL} AS names, hit IS NOT NULL AS listed, struct_extract_at(hit, 2) AS watch_kind,
  (amount > 100 OR (device_shift = 1 AND amount > 50)) AS escalates FROM lv LEFT JOIN watched ON alert_id = id),
done AS (SELECT transaction_id, entity_id, t, CASE WHEN listed OR risk_score >= 0.2078 THEN 'FRAUD' WHEN escalates THEN 'SUSPICIOUS' ELSE 'SAFE' END AS risk_label,
  CASE WHEN listed THEN greatest(risk_score, 0.99::DOUBLE) ELSE risk_score END AS risk_score,
  CASE WHEN listed THEN list_append(names, 'Watchlist:' || watch_kind) ELSE names END AS rules_triggered, tx_count_5m, tx_count_24h FROM verdicts)"""


def _scored(spark, folder):
    return live.scored(_events(spark, folder), RULES, watchlist(spark, folder))


@query("str8_stream_scoring", f"WITH {BURST} SELECT transaction_id, risk_label, risk_score, rules_triggered FROM done")
def str8(spark, folder):
    return stream.run(_scored(spark, folder).select("transaction_id", "risk_label", "risk_score", "rules_triggered"))


@query("job3_live_alerts", f"""WITH {BURST} SELECT transaction_id AS id, entity_id, risk_label, risk_score, tx_count_5m, tx_count_24h, 'open' AS status FROM done""")
def job3(spark, folder):
    path = files.scratch(spark, "alerts")
    live.run(_events(spark, folder), RULES, watchlist(spark, folder), path).awaitTermination()
    count = lambda name: F.get_json_object("feature_json", f"$.{name}").cast("long").alias(name)
    return keyed.read(spark, path).select("id", "entity_id", "risk_label", "risk_score", count("tx_count_5m"), count("tx_count_24h"), "status")


@query("job3_messages_to_alerts", f"""WITH {BURST} SELECT transaction_id::VARCHAR AS id, entity_id, risk_label, risk_score, tx_count_5m, tx_count_24h, 'open' AS status FROM done""")
def job3_messages(spark, folder):
    """JSON lines to the alert table: out of order by up to half an hour, every seventh message again a quarter of an hour later, broken
    lines and lines without an entity in between, and a last message that only moves the watermark."""
    rows = _fast(spark, folder)
    time = lambda column: F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = lambda ts: F.to_json(F.struct(F.col("transaction_id").cast("string").alias("transaction_id"), "entity_id", "amount", "merchant_id",
                                         F.col("device_id").alias("device_fingerprint"), time(ts).alias("timestamp")))
    arrival = F.col("event_time_seconds") + F.pmod(F.xxhash64("transaction_id"), F.lit(1800))
    whole = rows.select(arrival.alias("arrival"), body(F.col("event_ts")).alias("value"))
    again = rows.where("transaction_id % 7 = 0").select((arrival + 900).alias("arrival"), body(F.col("event_ts")).alias("value"))
    broken = rows.where("transaction_id % 11 = 0").select(arrival.alias("arrival"), F.lit('{"transaction_id":"x","am').alias("value"))
    keyless = rows.where("transaction_id % 13 = 0").select(arrival.alias("arrival"), F.to_json(F.struct(F.lit("y").alias("transaction_id"), "amount")).alias("value"))
    last = rows.agg(F.max("event_ts").alias("t")).where("t IS NOT NULL").select(F.to_json(F.struct(F.lit("z").alias("transaction_id"), F.lit("closing").alias("entity_id"), F.lit(0.0).alias("amount"),
                    time(F.col("t") + F.expr("INTERVAL 1 DAY")).alias("timestamp"))).alias("value"))
    messages = stream.from_text(spark, stream.replay(whole.unionByName(again).unionByName(broken).unionByName(keyless), ["arrival", "value"], text=True, last=last))
    path = files.scratch(spark, "alerts")
    live.run_messages(messages, RULES, watchlist(spark, folder), path).awaitTermination()
    count = lambda name: F.get_json_object("feature_json", f"$.{name}").cast("long").alias(name)
    return keyed.read(spark, path).select("id", "entity_id", "risk_label", "risk_score", count("tx_count_5m"), count("tx_count_24h"), "status")


@query("src16_scored_alert_sink", f"WITH {PLAIN_ALERTS} SELECT id, risk_label FROM pa")
def src16(spark, folder):
    """Every alert arrives in two triggers, every fifth twice in the second, and the second trigger is retried; each is stored once."""
    rows = tables.plain_alerts(spark, folder).select("id", "created_at", "risk_label")
    path = files.scratch(spark, "alerts")
    write = keyed.upsert(path, "id", buckets=16)
    write(rows, 0)
    for _ in range(2):
        write(rows.unionByName(rows.where("id % 5 = 0")).withColumn("risk_label", F.lit("AGAIN")), 1)
    return keyed.read(spark, path).select("id", "risk_label")


@query("src17_fraud_notifications", f"""WITH {PLAIN_ALERTS} SELECT transaction_id, 'FRAUD detected: transaction ' || transaction_id || ', entity ' || entity_id
|| ', risk score ' || round(risk_score * 100, 1)::VARCHAR || '%' AS message FROM pa WHERE risk_label = 'FRAUD'""")
def src17(spark, folder):
    rows = tables.plain_alerts(spark, folder).select("transaction_id", "entity_id", "risk_label", "risk_score")
    return stream.run(stream.notifications(_replayed(rows, ["transaction_id"])))


@query("jon9_stream_static_join", f"""WITH {PLAIN_ALERTS}, {WATCH}, {WATCHED.format('pa')}
SELECT id, struct_extract_at(hit, 1) AS watch_id FROM pa LEFT JOIN watched ON alert_id = id""")
def jon9(spark, folder):
    rows = tables.plain_alerts(spark, folder).select("id", "entity_id", "device_id", "merchant_id")
    matched = match_watchlist(_replayed(rows, ["id"]), watchlist(spark, folder))
    return stream.run(matched.select("id", F.col("watch.id").alias("watch_id")))


# ---------------------------------------------------------------- stateful features

@query("str2_running_zscore", f"""WITH {TX} SELECT transaction_id, round(CASE WHEN coalesce(stddev_samp(amount) OVER x, 0) > 0
THEN (amount - avg(amount) OVER x) / stddev_samp(amount) OVER x ELSE 0.0 END, 6) AS amount_zscore FROM tx
WINDOW x AS ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def str2(spark, folder):
    return _live(spark, folder).select("transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"))


@query("str3_burst_counters", f"""SELECT * FROM ({_burst_sql(300, 'count(*)', 'burst_count_5m')}) JOIN ({_burst_sql(3600, 'count(*)', 'burst_count_1h')}) USING (transaction_id)
JOIN ({_burst_sql(86400, 'count(*)', 'burst_count_24h')}) USING (transaction_id)
JOIN (SELECT transaction_id, round(burst_sum_1h, 6) AS burst_sum_1h FROM ({_burst_sql(3600, 'sum(amount)', 'burst_sum_1h')})) USING (transaction_id)""")
def str3(spark, folder):
    return _live(spark, folder).select("transaction_id", "burst_count_5m", "burst_count_1h", "burst_count_24h",
                                       F.round("burst_sum_1h", 6).alias("burst_sum_1h"))


@query("str4_sliding_counters", f"""WITH {TX} SELECT transaction_id, count(*) OVER ({W.format(300)}) - {LATER} AS tx_count_5m,
count(*) OVER ({W.format(3600)}) - {LATER} AS tx_count_1h, count(*) OVER ({W.format(86400)}) - {LATER} AS tx_count_24h FROM tx""")
def str4(spark, folder):
    return _live(spark, folder).select("transaction_id", "tx_count_5m", "tx_count_1h", "tx_count_24h")


@query("str5_sticky_shift", f"""WITH {TX}, steps AS (SELECT *, CASE WHEN lag(device_id) OVER ({SEQ}) <> device_id AND t - lag(t) OVER ({SEQ}) < 86400 THEN t END AS changed FROM tx)
SELECT transaction_id, CAST(coalesce(t - last_value(changed IGNORE NULLS) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 1800, false) AS INTEGER) AS device_shift FROM steps""")
def str5(spark, folder):
    return _live(spark, folder).select("transaction_id", "device_shift")


@query("str6_distinct_merchants", f"""WITH {TX} SELECT a.transaction_id, count(DISTINCT b.merchant_id) AS unique_merchants_1h FROM tx a JOIN tx b
ON a.account_id = b.account_id AND b.t > a.t - 3600 AND (b.t < a.t OR (b.t = a.t AND b.transaction_id <= a.transaction_id)) GROUP BY 1""")
def str6(spark, folder):
    return _live(spark, folder).select("transaction_id", "unique_merchants_1h")


@query("str14_latest_features", f"""WITH {TX}, z AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY t DESC, transaction_id DESC) AS rn,
count(*) OVER ({W.format(86400)}) - {LATER} AS tx_count_24h FROM tx) SELECT account_id AS entity_id, transaction_id, tx_count_24h FROM z WHERE rn = 1""")
def str14(spark, folder):
    path, order = files.scratch(spark, "latest"), ["event_ts", "transaction_id"]
    features = state.live_features(_events(spark, folder))
    stream.start(features, stream.latest_table(path, "entity_id", order)).awaitTermination()
    return stream.read_latest(spark, path, "entity_id", order).select("entity_id", "transaction_id", "tx_count_24h")


# ---------------------------------------------------------------- windows

@query("str7_deduplicate", f"WITH {TX} SELECT transaction_id, amount FROM tx")
def str7(spark, folder):
    """Each event is sent a second time a little later."""
    rows = _fast(spark, folder).select("transaction_id", "event_ts", "amount")
    again = rows.unionByName(rows)
    return stream.run(monitors.once(_replayed(again, ["event_ts", "transaction_id"])).select("transaction_id", "amount"))


def _alert_stream(spark, folder):
    rows = tables.plain_alerts(spark, folder).select(
        "id", F.col("created_at").alias("event_ts"), F.col("entity_id"), "risk_label", "risk_score", "amount", "device_id")
    return _replayed(rows, ["event_ts", "id"])


CLOSED = "(SELECT max(created_at) FROM pa) - INTERVAL 1 HOUR"
RATES_SQL = """count(*) AS total, count(*) FILTER (WHERE risk_label = 'FRAUD') AS fraud, count(*) FILTER (WHERE risk_label = 'SUSPICIOUS') AS suspicious,
round(count(*) FILTER (WHERE risk_label = 'FRAUD')::DOUBLE / count(*), 6) AS fraud_rate"""


@query("str9_verdict_windows", f"""WITH {PLAIN_ALERTS} SELECT date_trunc('hour', created_at) AS window_start, {RATES_SQL} FROM pa GROUP BY 1
HAVING date_trunc('hour', min(created_at)) + INTERVAL 1 HOUR <= {CLOSED}""")
def str9(spark, folder):
    return tables.ntz(stream.run(monitors.verdict_windows(_alert_stream(spark, folder))).drop("window_end"), "window_start")


@query("str9_sliding_rate", f"""WITH {PLAIN_ALERTS}, w AS (SELECT date_trunc('hour', created_at) - to_hours(h::INTEGER) AS window_start, * FROM pa, range(24) r(h))
SELECT window_start, {RATES_SQL} FROM w GROUP BY 1 HAVING window_start + INTERVAL 24 HOUR <= {CLOSED}""")
def str9_sliding(spark, folder):
    out = stream.run(monitors.verdict_windows(_alert_stream(spark, folder), "24 hours", "1 hour"))
    return tables.ntz(out.drop("window_end"), "window_start")


@query("str10_shadow_counters", f"""WITH {PLAIN_ALERTS}, v AS (SELECT risk_label = 'FRAUD' AS live, amount > 50 AS chal FROM pa)
SELECT count(*) AS samples, count(*) FILTER (WHERE live = chal) AS agree, count(*) FILTER (WHERE chal) AS challenger_fraud, count(*) FILTER (WHERE live) AS live_fraud FROM v""")
def str10(spark, folder):
    path = files.scratch(spark, "agreement")
    counters = monitors.agreement_counters(_alert_stream(spark, folder), F.col("risk_label") == "FRAUD", F.col("amount") > 50)
    stream.start(counters, lambda batch, epoch: batch.write.mode("overwrite").parquet(path), "complete").awaitTermination()
    return spark.read.parquet(path)


@query("str11_busy_windows", f"""WITH {PLAIN_ALERTS} SELECT device_id, date_trunc('hour', created_at) AS window_start, count(*) AS events FROM pa GROUP BY 1, 2
HAVING count(*) > 3 AND date_trunc('hour', min(created_at)) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM pa) - INTERVAL 1 MINUTE""")
def str11(spark, folder):
    busy = monitors.busy_windows(_alert_stream(spark, folder), "device_id", "1 hour", 3)
    return tables.ntz(stream.run(busy), "window_start")


@query("str11_opened_windows", f"""WITH RECURSIVE {TX}, s AS (SELECT *, row_number() OVER ({SEQ}) AS n FROM tx),
w AS (SELECT account_id, n, transaction_id, t AS window_start, 1::BIGINT AS window_count FROM s WHERE n = 1
UNION ALL SELECT s.account_id, s.n, s.transaction_id, CASE WHEN s.t - window_start >= 3600 THEN s.t ELSE window_start END,
CASE WHEN s.t - window_start >= 3600 THEN 1 ELSE window_count + 1 END FROM w JOIN s ON s.account_id = w.account_id AND s.n = w.n + 1)
SELECT account_id AS entity_id, transaction_id, window_start::DOUBLE AS window_start, window_count, window_count > 2 AS over_limit FROM w""")
def str11_opened(spark, folder):
    found = stream.run(state.opened_windows(_events(spark, folder), 3600, 2, "1 hour"))
    return found.select("entity_id", "transaction_id", F.col("window_start"), "window_count", "over_limit")


@query("str12_sessions", f"""WITH {PLAIN_ALERTS}, m AS (SELECT *, CASE WHEN lag(created_at) OVER (PARTITION BY entity_id ORDER BY created_at, id) IS NULL
OR created_at >= lag(created_at) OVER (PARTITION BY entity_id ORDER BY created_at, id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS s FROM pa),
n AS (SELECT *, sum(s) OVER (PARTITION BY entity_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT entity_id, min(created_at) AS session_start, max(created_at) + INTERVAL 1 HOUR AS session_end, count(*) AS events, round(sum(amount), 4) AS amount FROM n
GROUP BY entity_id, no HAVING max(created_at) + INTERVAL 1 HOUR <= {CLOSED}""")
def str12(spark, folder):
    return tables.ntz(stream.run(monitors.activity_sessions(_alert_stream(spark, folder))), "session_start", "session_end")


@query("str13_late_rows")
def str13(spark, folder):
    """Large sign-ups arrive with the last file; what the watermark has passed is dropped and counted."""
    rows = tables.plain_alerts(spark, folder).select("id", F.col("created_at").alias("event_ts"), "risk_label")
    late = (F.col("device_id") == "signup") & (F.col("amount") > 100)
    arrival = tables.plain_alerts(spark, folder).select("id", late.alias("late"))
    rows = rows.join(arrival, "id")
    windows = monitors.verdict_windows(_replayed(rows, ["late", "event_ts"]))
    path = files.scratch(spark, "late")
    query_ = stream.start(windows, path)
    query_.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query_.recentProgress for op in p["stateOperators"])
    kept = spark.read.schema(windows.schema).parquet(path).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("rows_in_closed_windows"))
    return kept.withColumn("dropped", F.lit(dropped))


# ---------------------------------------------------------------- the analytics job

@query("job4_analytics_pack", f"""WITH {ALERTS}, {FEEDBACK}, recent AS (SELECT * FROM al WHERE created_at >= (SELECT max(created_at) FROM al) - INTERVAL 30 DAY),
placed AS (SELECT {CODES}[{_mod_sql('u', 10)} + 1] AS code FROM (SELECT {uuid5_sql('entity_id')} AS u FROM recent)),
flagged AS (SELECT count(*) AS flags FROM al WHERE risk_label <> 'SAFE' GROUP BY entity_id ORDER BY flags DESC LIMIT 8),
people AS (SELECT least(count(*), 500) AS n FROM al GROUP BY entity_id)
SELECT 'series' AS part, count(DISTINCT created_at::DATE) AS n, 0::BIGINT AS total FROM al WHERE created_at >= (SELECT max(created_at) FROM al) - INTERVAL 14 DAY
UNION ALL SELECT 'countries', count(DISTINCT code), count(*) FROM placed UNION ALL SELECT 'top_entities', count(*), sum(flags)::BIGINT FROM flagged
UNION ALL SELECT 'profiles', count(*), sum(n)::BIGINT FROM people UNION ALL SELECT 'drift', 3, 0 UNION ALL SELECT 'summary', 1, 0 UNION ALL SELECT 'impact', 1, count(*) FILTER
(WHERE risk_label = 'FRAUD') FROM recent UNION ALL SELECT 'monitor', 1, count(*) FROM al WHERE created_at >= (SELECT max(created_at) FROM al) - INTERVAL 24 HOUR
UNION ALL SELECT 'feedback', 1, count(*) FROM fb""")
def job4(spark, folder):
    """Rows of each part, and a total of what it counts where it counts alerts or answers."""
    counted = {"countries": "total", "top_entities": "flags", "profiles": "transactions", "impact": "fraud_count", "monitor": "baseline_total", "feedback": "total"}
    out = None
    for name, part in analytics.pack(tables.alerts(spark, folder), tables.feedback(spark, folder)).items():
        total = F.coalesce(F.sum(counted[name]), F.lit(0)).cast("long") if name in counted else F.lit(0).cast("long")
        row = part.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out
