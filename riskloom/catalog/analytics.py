"""Alert analytics, case data and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import ALERTS, AUDIT, FEEDBACK, LATEST_FEEDBACK, NOTES, PLAIN_ALERTS, TX
from riskloom.catalog.verdicts import AS_OF, CODES, _mod_sql, uuid5_sql
from riskloom.operators import attribution, cases, insights, ranking
from riskloom.sources import tables

COUNTS = """count(*) AS transactions, (count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud,
(count(*) FILTER (WHERE risk_label = 'SUSPICIOUS')) AS suspicious, (count(*) FILTER (WHERE risk_label = 'SAFE')) AS safe"""


@query("agg8_verdict_totals", f"""WITH {PLAIN_ALERTS} SELECT {COUNTS}, (count(*) FILTER (WHERE status = 'open' AND risk_label <> 'SAFE')) AS open_cases,
round((count(*) FILTER (WHERE risk_label = 'FRAUD'))::DOUBLE / count(*) * 100, 2) AS fraud_rate FROM pa""")
def agg8(spark, folder):
    return insights.verdict_totals(tables.plain_alerts(spark, folder))


@query("agg9_daily_series", f"""WITH {ALERTS} SELECT strftime(created_at, '%Y-%m-%d') AS date,
(count(*) FILTER (WHERE risk_label = 'SAFE')) AS safe, (count(*) FILTER (WHERE risk_label = 'SUSPICIOUS')) AS suspicious,
(count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud, round(coalesce(sum(sum_amount_1h) FILTER (WHERE risk_label = 'FRAUD'), 0), 4) AS blocked
FROM al WHERE created_at >= (SELECT max(created_at) FROM al) - INTERVAL 14 DAY GROUP BY 1""")
def agg9(spark, folder):
    rows = tables.alerts(spark, folder)
    return insights.daily_series(rows, insights.newest(rows), 14)


@query("agg8_summary", f"""WITH {ALERTS} SELECT count(*) AS transactions, (count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud,
(count(*) FILTER (WHERE status = 'open' AND risk_label <> 'SAFE')) AS open_cases, round(coalesce(sum(sum_amount_1h) FILTER
(WHERE risk_label = 'FRAUD' AND created_at >= (SELECT max(created_at) FROM pa) - INTERVAL 14 DAY), 0), 2) AS amount_blocked,
round((count(*) FILTER (WHERE risk_label = 'FRAUD'))::DOUBLE / count(*) * 100, 2) AS fraud_rate FROM al""")
def agg8_summary(spark, folder):
    rows = tables.alerts(spark, folder)
    return insights.summary(rows, insights.newest(rows), 14)


@query("agg10_impact", f"""WITH {ALERTS}, w AS (SELECT * FROM al WHERE created_at >= (SELECT max(created_at) FROM al) - INTERVAL 20 DAY),
s AS (SELECT sum(sum_amount_1h) FILTER (WHERE risk_label = 'FRAUD') AS caught, sum(sum_amount_1h) FILTER (WHERE risk_label = 'SUSPICIOUS') AS exposed,
count(*) FILTER (WHERE risk_label = 'FRAUD') AS fraud_count, count(*) FILTER (WHERE risk_label = 'SUSPICIOUS') AS suspicious_count FROM w)
SELECT round(caught, 2) AS value_caught, round(exposed, 2) AS exposure_open, round(suspicious_count * 12.0::DOUBLE, 2) AS fp_review_cost,
round(caught - round(suspicious_count * 12.0::DOUBLE, 2), 2) AS net_protected, fraud_count, suspicious_count FROM s""")
def agg10(spark, folder):
    rows = tables.alerts(spark, folder)
    return insights.impact(rows, insights.newest(rows), 20)


COUNTRY_ROWS = f"""located AS (SELECT *, {CODES}[{_mod_sql('u', 10)} + 1] AS code FROM (SELECT *, {uuid5_sql('entity_id')} AS u FROM pa))"""


@query("agg11_countries", f"""WITH {PLAIN_ALERTS}, {COUNTRY_ROWS},
names AS (SELECT unnest({CODES}) AS code, unnest(['United States','United Kingdom','Germany','Nigeria','Brazil','India','Russia','Singapore','France','China']) AS country)
SELECT code, country, count(*) AS total, (count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud,
round((count(*) FILTER (WHERE risk_label = 'FRAUD'))::DOUBLE / count(*) * 100, 1) AS fraud_rate
FROM located JOIN names USING (code) WHERE created_at >= {AS_OF} - INTERVAL 20 DAY GROUP BY 1, 2""")
def agg11(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.by_country(rows, insights.newest(rows), 20)


@query("agg12_fraud_rate_hours", f"""WITH {PLAIN_ALERTS} SELECT count(*) AS total, (count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud,
round((count(*) FILTER (WHERE risk_label = 'FRAUD'))::DOUBLE / count(*), 6) AS rate FROM pa WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR""")
def agg12(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.fraud_rate(rows, insights.newest(rows), 24)


@query("agg13_outcome_monitor", f"""WITH {PLAIN_ALERTS}, m AS (SELECT (count(*) FILTER (WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR)) AS recent_total,
(count(*) FILTER (WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR AND risk_label = 'FRAUD')) AS recent_fraud, count(*) AS baseline_total,
(count(*) FILTER (WHERE risk_label = 'FRAUD')) AS baseline_fraud FROM pa WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR),
r AS (SELECT *, recent_fraud::DOUBLE / recent_total AS rr, baseline_fraud::DOUBLE / baseline_total AS br FROM m)
SELECT recent_total, recent_fraud, baseline_total, baseline_fraud, CASE WHEN recent_total < 5 OR baseline_total < 20 THEN 'insufficient'
WHEN rr / br >= 1.75 AND rr > 0.1 THEN 'spike' WHEN rr / br >= 1.25 THEN 'elevated' ELSE 'normal' END AS status,
round(rr * 100, 2) AS recent_rate, round(br * 100, 2) AS baseline_rate, round(rr / br, 2) AS ratio FROM r""")
def agg13(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.monitor(rows, insights.newest(rows))


@query("agg14_entity_profiles", f"""WITH {ALERTS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
ORDER BY created_at DESC, id DESC) AS rn FROM al) WHERE rn <= 40), g AS (SELECT entity_id, {COUNTS},
(count(*) FILTER (WHERE device_shift = 1)) AS device_shifts, avg(sum_amount_1h) AS mean, stddev_pop(sum_amount_1h) AS std,
avg(tx_count_1h) AS vel, avg(risk_score) AS risk, arg_min(sum_amount_1h, rn) AS latest FROM r GROUP BY entity_id)
SELECT entity_id, {CODES}[{_mod_sql('u', 10)} + 1] AS country_code, transactions, fraud, suspicious, safe, device_shifts,
round(mean, 2) AS avg_amount, round(std, 2) AS std_amount, round(vel, 1) AS avg_velocity_1h, round(risk, 3) AS avg_risk,
round(latest, 2) AS latest_amount, round(CASE WHEN std > 0 THEN (latest - mean) / std ELSE 0 END, 2) AS latest_amount_z
FROM (SELECT *, {uuid5_sql('entity_id')} AS u FROM g)""")
def agg14(spark, folder):
    """The newest 40 alerts of each entity, so that the limit matters on the test tables."""
    return insights.entity_profiles(tables.alerts(spark, folder), 40)


@query("agg15_feedback_stats", f"""WITH {FEEDBACK}, s AS (SELECT count(*) AS total, (count(*) FILTER (WHERE label = 'confirmed_fraud')) AS confirmed_fraud,
(count(*) FILTER (WHERE label = 'false_positive')) AS false_positive FROM fb)
SELECT *, round(confirmed_fraud::DOUBLE / (confirmed_fraud + false_positive), 3) AS labelled_precision FROM s""")
def agg15(spark, folder):
    return insights.feedback_stats(tables.feedback(spark, folder))


@query("agg15_recent_feedback", f"WITH {FEEDBACK} SELECT id, alert_id, label, analyst FROM fb ORDER BY created_at DESC, id DESC LIMIT 12")
def agg15_recent(spark, folder):
    return insights.recent_feedback(tables.feedback(spark, folder))


@query("agg23_latency_histogram", f"""WITH {PLAIN_ALERTS}, b AS (SELECT unnest([0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS bound)
SELECT risk_label, bound::VARCHAR AS le, (count(*) FILTER (WHERE amount / 1000 <= bound)) AS count FROM pa, b GROUP BY 1, 2
UNION ALL SELECT risk_label, '+Inf', count(*) FROM pa GROUP BY 1""")
def agg23(spark, folder):
    scored = tables.plain_alerts(spark, folder).withColumn("latency_s", F.col("amount") / 1000)
    return insights.latency_histogram(scored)


@query("agg25_key_skew", f"""WITH {TX}, s AS (SELECT account_id, count(*) AS n FROM tx GROUP BY 1), w AS (SELECT count(*) OVER
(PARTITION BY account_id ORDER BY t RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW) AS c FROM tx)
SELECT count(*) AS n_keys, quantile_cont(n, 0.5) AS median_rows, quantile_cont(n, 0.99) AS p99_rows, max(n) AS max_rows,
(SELECT max(c) FROM w) AS max_rows_in_window FROM s""")
def agg25(spark, folder):
    return insights.key_skew(tables.transactions(spark, folder), window=20000)


# ---------------------------------------------------------------- joins over case data

@query("jon3_alerts_with_feedback", f"WITH {PLAIN_ALERTS}, {LATEST_FEEDBACK} SELECT id, risk_label, label AS disposition FROM pa LEFT JOIN lf ON alert_id = id")
def jon3(spark, folder):
    return cases.with_feedback(tables.plain_alerts(spark, folder), tables.feedback(spark, folder)).select("id", "risk_label", "disposition")


@query("jon4_audit_actors", f"WITH {AUDIT} SELECT id, action, coalesce(email, actor_id::VARCHAR) AS actor FROM au LEFT JOIN us ON user_id = actor_id")
def jon4(spark, folder):
    return cases.with_actor(tables.audit(spark, folder), tables.users(spark, folder)).select("id", "action", "actor")


TIMELINE_SQL = f"""WITH {PLAIN_ALERTS}, {AUDIT}, {NOTES}, {FEEDBACK}
SELECT id AS alert_id, created_at AS ts, 'detected' AS kind, 'system' AS actor,
'Transaction scored ' || risk_label || ' (' || round(risk_score * 100, 1)::VARCHAR || '%)' AS text FROM pa
UNION ALL SELECT target_id, created_at, 'action', coalesce(email, actor_id::VARCHAR), action FROM au LEFT JOIN us ON user_id = actor_id
UNION ALL SELECT alert_id, created_at, 'note', author, body FROM nt
UNION ALL SELECT alert_id, created_at, 'feedback', analyst, replace(label, '_', ' ') FROM fb"""


def _timeline(spark, folder):
    audit = cases.with_actor(tables.audit(spark, folder), tables.users(spark, folder))
    return tables.ntz(cases.timeline(tables.plain_alerts(spark, folder), audit, tables.notes(spark, folder), tables.feedback(spark, folder)), "ts")


@query("jon10_case_timeline", TIMELINE_SQL)
def jon10(spark, folder):
    return _timeline(spark, folder).orderBy("alert_id", "ts", "kind")


@query("set3_timeline_union", f"SELECT kind, count(*) AS n FROM ({TIMELINE_SQL}) GROUP BY kind")
def set3(spark, folder):
    return _timeline(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("jon11_case_files", f"""WITH {ALERTS}, {NOTES}, {LATEST_FEEDBACK}, pn AS (SELECT *, (row_number() OVER (PARTITION BY alert_id
ORDER BY created_at, id) - 1) // 100 AS page, count(*) OVER (PARTITION BY alert_id) AS c FROM nt),
n AS (SELECT alert_id, page, any_value(c) AS c, string_agg(body, '; ' ORDER BY created_at, id) AS bodies FROM pn GROUP BY 1, 2)
SELECT al.id, risk_label, status, label AS disposition, coalesce(c, 0) AS note_count, bodies AS note_text,
round(tx_count_5m * 0.05::DOUBLE, 4) AS first_attribution, tx_count_24h::DOUBLE AS third_feature
FROM al LEFT JOIN lf ON lf.alert_id = al.id LEFT JOIN n ON n.alert_id = al.id""")
def jon11(spark, folder):
    files = cases.case_files(tables.alerts(spark, folder).withColumn("avg_amount_1h", F.col("sum_amount_1h") / F.col("tx_count_1h")),
                             tables.notes(spark, folder), tables.feedback(spark, folder), attribution.heuristic())
    return files.select(
        "id", "risk_label", "status", "disposition", "note_count",
        F.when(F.col("notes").isNotNull(), F.array_join(F.transform("notes", lambda n: n["body"]), "; ")).alias("note_text"),
        F.col("attributions")["tx_count_5m"].alias("first_attribution"), F.col("features")[2].alias("third_feature"))


# ---------------------------------------------------------------- sorted reads

@query("top1_alert_page", f"WITH {PLAIN_ALERTS} SELECT id, entity_id, risk_label FROM pa ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 100")
def top1(spark, folder):
    return insights.page(tables.plain_alerts(spark, folder), 100, 200).select("id", "entity_id", "risk_label")


@query("top1_keyset_page", f"""WITH {PLAIN_ALERTS}, edge AS (SELECT created_at, id FROM pa ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 99)
SELECT id, entity_id, risk_label FROM pa WHERE (created_at, id) < (SELECT (created_at, id) FROM edge) ORDER BY created_at DESC, id DESC LIMIT 200""")
def top1_keyset(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    edge = insights.page(rows, 99, 1).select("created_at", "id").first()
    return insights.page_after(rows, edge.created_at, edge.id, 200).select("id", "entity_id", "risk_label")


@query("top2_top_entities", f"""WITH {PLAIN_ALERTS} SELECT entity_id, count(*) AS flags, round(max(risk_score), 3) AS max_score FROM pa
WHERE risk_label <> 'SAFE' GROUP BY 1 ORDER BY flags DESC, entity_id LIMIT 8""")
def top2(spark, folder):
    return insights.top_entities(tables.plain_alerts(spark, folder))


@query("top3_by_risk", f"WITH {PLAIN_ALERTS} SELECT id, risk_score FROM pa WHERE risk_label = 'SUSPICIOUS'")
def top3(spark, folder):
    return insights.search(tables.plain_alerts(spark, folder), label="SUSPICIOUS").orderBy(F.desc("risk_score"), "id").select("id", "risk_score")


@query("top4_top_attributions", f"""WITH {ALERTS}, h AS (SELECT id, unnest([{{'f': 'tx_count_5m', 'v': round(tx_count_5m * 0.05, 4)}},
{{'f': 'tx_count_1h', 'v': round(tx_count_1h * 0.01, 4)}}, {{'f': 'tx_count_24h', 'v': round(tx_count_24h * -0.002, 4)}},
{{'f': 'device_shift', 'v': CASE WHEN device_shift = 1 THEN 0.35::DOUBLE ELSE -0.05::DOUBLE END}}], recursive := true) FROM al)
SELECT id, f AS feature, round(v, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, f) AS rn FROM h) WHERE rn <= 2""")
def top4(spark, folder):
    """The two strongest of four contributions."""
    rows = tables.alerts(spark, folder)
    values = F.map_filter(attribution.heuristic(with_amount=False), lambda k, v: v.isNotNull())
    return rows.select("id", F.inline(attribution.strongest(values, 2))).select("id", "feature", F.round("value", 4).alias("value"))


@query("top6_live_feed", f"WITH {PLAIN_ALERTS} SELECT id, risk_label FROM pa ORDER BY created_at DESC, id DESC LIMIT 50")
def top6(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.live_feed(rows.unionByName(rows)).select("id", "risk_label")


@query("top7_entity_history", f"""WITH {PLAIN_ALERTS} SELECT entity_id, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
ORDER BY created_at DESC, id DESC) AS rn FROM pa) WHERE rn <= 20""")
def top7(spark, folder):
    order = [F.desc("created_at"), F.desc("id")]
    return ranking.top_per_key(tables.plain_alerts(spark, folder), ["entity_id"], order, 20).select("entity_id", "id")


@query("top7_audit_feed", f"""WITH {AUDIT} SELECT id, coalesce(email, actor_id::VARCHAR) AS actor FROM au LEFT JOIN us ON user_id = actor_id
ORDER BY created_at DESC, id DESC LIMIT 100""")
def top7_audit(spark, folder):
    newest = insights.page(tables.audit(spark, folder), 0, 100)
    return cases.with_actor(newest, tables.users(spark, folder)).select("id", "actor")


@query("set4_merge_page", f"""WITH {PLAIN_ALERTS}, feed AS (SELECT id FROM pa ORDER BY created_at DESC, id DESC LIMIT 50),
page AS (SELECT id FROM pa ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 25) SELECT id FROM feed UNION SELECT id FROM page""")
def set4(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.unseen(insights.page(rows, 25, 50), insights.live_feed(rows)).select("id")


# ---------------------------------------------------------------- drift

def _psi_sql(features):
    parts = []
    for f in features:
        parts.append(f"""SELECT '{f}' AS feature, CASE WHEN count(*) < 1 THEN 0 ELSE round(sum((r - b) * ln(r / b)), 4) END AS psi,
        any_value(n) AS n FROM (SELECT greatest(count(x.bin) FILTER (WHERE half = 'base') / max(nb)::DOUBLE, 1e-6) AS b,
        greatest(count(x.bin) FILTER (WHERE half = 'recent') / max(nr)::DOUBLE, 1e-6) AS r, max(nb + nr) AS n
        FROM (SELECT half, least(9, greatest(0, floor(({f} - lo) / (hi - lo) * 10))) AS bin FROM h, (SELECT min({f})::DOUBLE AS lo, max({f})::DOUBLE AS hi FROM h)) x,
        (SELECT count(*) FILTER (WHERE half = 'base') AS nb, count(*) FILTER (WHERE half = 'recent') AS nr FROM h) GROUP BY bin)""")
    return " UNION ALL ".join(parts)


DRIFT = ["tx_count_1h", "sum_amount_1h", "tx_count_24h"]


@query("ml16_psi_drift", f"""WITH {ALERTS}, h AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY created_at DESC, id DESC) <= (SELECT count(*) // 2 FROM al)
THEN 'recent' ELSE 'base' END AS half FROM al), p AS ({_psi_sql(DRIFT)})
SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'drift' END AS status, n FROM p""")
def ml16(spark, folder):
    return insights.psi(ranking.halves(tables.alerts(spark, folder), "created_at", "id"), DRIFT)
