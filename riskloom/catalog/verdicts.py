"""Scores, verdicts, rules, watchlists and scalar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import ALERTS, LATEST_FEEDBACK, PLAIN_ALERTS, TX
from riskloom.contracts import TEST_RULES
from riskloom.functions import scalar
from riskloom.operators import cases, decisions, insights, rule_index
from riskloom.sources import tables

RULES = TEST_RULES
RULE_SQL = {
    "Burst over two": "tx_count_5m > 2", "Amount over 100": "amount > 100", "Shift over 50": "device_shift = 1 AND amount > 50",
    "Over a million a day": "amount > 1000000 AND tx_count_24h > 1",
}
NAMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_SQL.items()) + "], lambda x: x IS NOT NULL)"


# ---------------------------------------------------------------- projections

@query("prj6_verdict", f"WITH {PLAIN_ALERTS} SELECT id, risk_label FROM pa")
def prj6(spark, folder):
    score = tables.fixed_score(F.col("event_id"))
    return tables.table(spark, folder, "events").select(F.col("event_id").alias("id"), decisions.verdict(score).alias("risk_label"))


@query("prj7_heuristic_score", f"""WITH {ALERTS} SELECT id, CASE WHEN device_shift = 1 OR amount > 2000 THEN 0.85::DOUBLE
ELSE 0.05::DOUBLE END AS risk_score FROM al""")
def prj7(spark, folder):
    score = decisions.heuristic_score(F.col("device_shift"), F.col("amount"))
    return tables.alerts(spark, folder).select("id", score.alias("risk_score"))


@query("prj8_search", f"""WITH {PLAIN_ALERTS} SELECT id, entity_id, risk_score FROM pa
WHERE risk_label = 'FRAUD' AND contains(lower(entity_id || ' ' || id), '42')""")
def prj8(spark, folder):
    return insights.search(tables.plain_alerts(spark, folder), " 42", "FRAUD").select("id", "entity_id", "risk_score")


@query("prj9_rule_predicates", f"WITH {ALERTS} SELECT id, {NAMES_SQL} AS rules_triggered FROM al")
def prj9(spark, folder):
    rows = tables.alerts(spark, folder)
    return rows.select("id", F.transform(decisions.triggered(rows, RULES), lambda r: r["name"]).alias("rules_triggered"))


DRAFT_FIELDS = ("amount", "tx_count_5m", "risk_score", "merchant", "device_shift")
DRAFT_OPS = (">", "<=", "~", "==")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


@query("prj10_rule_validation", """SELECT p_partkey AS id, CASE WHEN p_retailprice < 920 THEN 'no conditions'
WHEN ['amount','tx_count_5m','risk_score','merchant','device_shift'][p_size % 5 + 1] = 'merchant' THEN 'unknown field'
WHEN ['>','<=','~','=='][p_partkey % 4 + 1] = '~' THEN 'unknown comparison'
WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 'unknown action' END AS rejected_because FROM part""")
def prj10(spark, folder):
    """Rule drafts read off the part table, some of them broken."""
    part = tables.table(spark, folder, "part")
    lowest = part.agg(F.min("p_brand").alias("lowest"))
    condition = F.struct(_pick(DRAFT_FIELDS, F.col("p_size")).alias("field"), _pick(DRAFT_OPS, F.col("p_partkey")).alias("op"),
                         F.col("p_retailprice").alias("value"))
    empty = F.array().cast("array<struct<field:string,op:string,value:double>>")
    action = F.when(F.col("p_brand") == F.lit(lowest.first().lowest), "block").otherwise("flag")
    drafts = part.select(F.col("p_partkey").alias("id"), action.alias("action"),
                         F.when(F.col("p_retailprice") < 920, empty).otherwise(F.array(condition)).alias("conditions"))
    return decisions.validate_rules(drafts).select("id", "rejected_because")


AS_OF = "(SELECT max(created_at) FROM pa)"


@query("prj11_sla_ageing", f"""WITH {PLAIN_ALERTS} SELECT id, CASE
WHEN floor(epoch({AS_OF})) - floor(epoch(created_at)) > 14400 THEN 'overdue'
WHEN floor(epoch({AS_OF})) - floor(epoch(created_at)) > 3600 THEN 'ageing' ELSE 'on time' END AS sla
FROM pa WHERE risk_label <> 'SAFE' AND status NOT IN ('resolved', 'dismissed')""")
def prj11(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return insights.sla(rows, insights.newest(rows)).select("id", "sla")


@query("prj12_scatter", f"""WITH {ALERTS} SELECT id, tx_count_1h AS velocity, round(sum_amount_1h, 4) AS amount, risk_label FROM al""")
def prj12(spark, folder):
    return tables.alerts(spark, folder).select(
        "id", F.col("tx_count_1h").alias("velocity"), F.round("sum_amount_1h", 4).alias("amount"), "risk_label")


# ---------------------------------------------------------------- rules and watchlists

NATION_RULES = "amount > n_nationkey * 20 AND device_shift = n_regionkey % 2"


@query("jon5_rules_join", f"""WITH {ALERTS} SELECT id, n_name AS rule_name FROM al JOIN nation ON {NATION_RULES}""")
def jon5(spark, folder):
    """One rule per nation, read from the table."""
    nation = tables.table(spark, folder, "nation")
    condition = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.cast("double").alias("value"))
    rules = nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("flag").alias("action"),
        F.array(condition("amount", ">", F.col("n_nationkey") * 20),
                condition("device_shift", "==", F.col("n_regionkey") % 2)).alias("conditions"))
    hits = rule_index.hits(tables.alerts(spark, folder).withColumnRenamed("id", "alert_id"), rules, ["alert_id"])
    return hits.select(F.col("alert_id").alias("id"), "rule_name")


def part_rules(spark, folder):
    """One rule per part: a band of amounts a quarter wide, some with a minimum of transactions, and every eleventh without a condition."""
    condition = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.cast("double").alias("value"))
    low = F.col("p_retailprice") / 10
    band = [condition("amount", ">=", low), condition("amount", "<", low + 0.25)]
    return tables.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") > 25, "escalate").otherwise("flag").alias("action"),
        F.when(F.col("p_partkey") % 11 == 0, F.array().cast("array<struct<field:string,op:string,value:double>>"))
        .when(F.col("p_partkey") % 2 == 0, F.array(*band, condition("tx_count_24h", "!=", F.lit(2))))
        .otherwise(F.array(*band, condition("device_shift", "==", F.lit(1)))).alias("conditions"))


PART_RULES = """amount >= p_retailprice / 10 AND amount < p_retailprice / 10 + 0.25 AND p_partkey % 11 <> 0
AND CASE WHEN p_partkey % 2 = 0 THEN tx_count_24h <> 2 ELSE device_shift = 1 END"""


@query("jon5_rule_table", f"""WITH {ALERTS} SELECT id, p_partkey::VARCHAR AS rule_id, CASE WHEN p_size > 25 THEN 'escalate' ELSE 'flag' END AS rule_action
FROM al JOIN part ON {PART_RULES}""")
def jon5_rule_table(spark, folder):
    """As many rules as there are parts, matched from the rule table."""
    hits = rule_index.hits(tables.alerts(spark, folder).withColumnRenamed("id", "alert_id"), part_rules(spark, folder), ["alert_id"])
    return hits.select(F.col("alert_id").alias("id"), "rule_id", "rule_action")


@query("prj9_rule_table_decision", f"""WITH {ALERTS}, hit AS (SELECT id AS hit_id, count(*) AS rules, bool_or(p_size > 25) AS escalates FROM al JOIN part ON {PART_RULES} GROUP BY id)
SELECT id, coalesce(rules, 0) AS rules, CASE WHEN NOT coalesce(escalates, false) THEN risk_label WHEN risk_label = 'SAFE' THEN 'SUSPICIOUS' ELSE 'FRAUD' END AS risk_label
FROM al LEFT JOIN hit ON id = hit_id""")
def prj9_rule_table(spark, folder):
    """The decision with as many rules as there are parts, without a shuffle for the rules."""
    out = decisions.decide(tables.alerts(spark, folder), part_rules(spark, folder))
    return out.select("id", F.size("rules_triggered").cast("long").alias("rules"), "risk_label")


def watchlist(spark, folder):
    """Customers in debt as entities, event types with very large amounts as devices, indebted suppliers as merchants."""
    reason = F.lit("table").alias("reason")
    entity = tables.table(spark, folder, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), F.lit("entity").alias("kind"),
        F.col("c_custkey").cast("string").alias("value"), reason)
    device = tables.table(spark, folder, "events").where("value > 355").select("event_type").distinct().select(
        F.concat(F.lit("d"), F.col("event_type")).alias("id"), F.lit("device").alias("kind"), F.col("event_type").alias("value"), reason)
    merchant = tables.table(spark, folder, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("merchant").alias("kind"),
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("value"), reason)
    return entity.unionByName(device).unionByName(merchant)


WATCH = """wl AS (SELECT 'e' || c_custkey AS id, 'entity' AS kind, c_custkey::VARCHAR AS value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT DISTINCT 'd' || event_type, 'device', event_type FROM events WHERE value > 355
UNION ALL SELECT 'm' || s_suppkey, 'merchant', 'm' || s_suppkey FROM supplier WHERE s_acctbal < 0)"""
WATCHED = """watched AS (SELECT a.id AS alert_id, min((w.id, w.kind)) AS hit FROM {} a JOIN wl w ON
(w.kind = 'entity' AND w.value = a.entity_id) OR (w.kind = 'device' AND w.value = a.device_id)
OR (w.kind = 'merchant' AND w.value = a.merchant_id) GROUP BY a.id)"""


@query("jon6_watchlist_join", f"""WITH {PLAIN_ALERTS}, {WATCH}, {WATCHED.format('pa')}
SELECT alert_id AS id, struct_extract_at(hit, 1) AS watch_id, struct_extract_at(hit, 2) AS watch_kind FROM watched""")
def jon6(spark, folder):
    hits = decisions.match_watchlist(tables.plain_alerts(spark, folder), watchlist(spark, folder))
    return hits.where("watch IS NOT NULL").select("id", F.col("watch.id").alias("watch_id"), F.col("watch.kind").alias("watch_kind"))


@query("jon6_watchlist_legacy", f"""WITH {PLAIN_ALERTS}, {WATCH.replace("'merchant', 'm' || s_suppkey", "'merchant', s_suppkey::VARCHAR")},
{WATCHED.format('pa').replace('w.value = a.merchant_id', 'w.value = a.entity_id')}
SELECT alert_id AS id, struct_extract_at(hit, 1) AS watch_id FROM watched""")
def jon6_legacy(spark, folder):
    """Merchant entries compared with the entity, as the older matcher does."""
    plain_value = F.when(F.col("kind") == "merchant", F.substring("value", 2, 100)).otherwise(F.col("value"))
    entries = watchlist(spark, folder).withColumn("value", plain_value)
    hits = decisions.match_watchlist(tables.plain_alerts(spark, folder), entries, legacy_merchant_match=True)
    return hits.where("watch IS NOT NULL").select("id", F.col("watch.id").alias("watch_id"))


DECIDED = f"""{ALERTS}, {WATCH}, {WATCHED.format('al')},
dec AS (SELECT al.*, {NAMES_SQL} AS names, hit IS NOT NULL AS listed, struct_extract_at(hit, 2) AS watch_kind,
  (amount > 5000 OR (device_shift = 1 AND amount > 1000) OR amount > 100 OR (device_shift = 1 AND amount > 50)) AS escalates
  FROM al LEFT JOIN watched ON alert_id = id),
decided AS (SELECT id, CASE WHEN listed OR risk_label = 'FRAUD' OR (escalates AND risk_label = 'SUSPICIOUS') THEN 'FRAUD'
  WHEN escalates OR risk_label = 'SUSPICIOUS' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS risk_label,
  CASE WHEN listed THEN greatest(risk_score, 0.99::DOUBLE) ELSE risk_score END AS risk_score,
  CASE WHEN listed THEN list_append(names, 'Watchlist:' || watch_kind) ELSE names END AS rules_triggered FROM dec)"""


def decided(spark, folder):
    return decisions.decide(tables.alerts(spark, folder), RULES, watchlist(spark, folder))


@query("decision_chain", f"WITH {DECIDED} SELECT id, risk_label, risk_score, rules_triggered FROM decided")
def decision_chain(spark, folder):
    return decided(spark, folder).select("id", "risk_label", "risk_score", "rules_triggered")


@query("agg24_rule_hit_counts", f"""WITH {DECIDED} SELECT rule_name, count(*) AS hits
FROM (SELECT unnest(rules_triggered) AS rule_name FROM decided) GROUP BY rule_name""")
def agg24(spark, folder):
    return decisions.rule_hit_counts(decided(spark, folder))


BULK = f"""{ALERTS}, bulk AS (SELECT id AS transaction_id, entity_id, round(amount, 2) AS amount,
CASE WHEN device_shift = 1 OR amount > 2000 THEN 0.85::DOUBLE ELSE 0.05::DOUBLE END AS risk_score,
CASE WHEN device_shift = 1 OR amount > 2000 THEN 'FRAUD' ELSE 'SAFE' END AS risk_label, {NAMES_SQL} AS rules_triggered FROM al)"""


def _bulk(spark, folder):
    return decisions.score_bulk(tables.alerts(spark, folder), RULES)


@query("ml13_bulk_scoring", f"WITH {BULK} SELECT * FROM bulk")
def ml13(spark, folder):
    return _bulk(spark, folder)


@query("agg17_bulk_summary", f"WITH {BULK} SELECT risk_label, count(*) AS n FROM bulk GROUP BY risk_label")
def agg17(spark, folder):
    return _bulk(spark, folder).groupBy("risk_label").agg(F.count(F.lit(1)).alias("n"))


BACKTEST = " UNION ALL ".join(f"""SELECT '{name}' AS rule_name, count(*) AS total_scanned, (count(*) FILTER (WHERE {cond})) AS matched,
(count(*) FILTER (WHERE ({cond}) AND risk_label = 'FRAUD')) AS matched_fraud, (count(*) FILTER (WHERE ({cond}) AND risk_label = 'SAFE')) AS matched_safe,
(count(*) FILTER (WHERE ({cond}) AND label = 'confirmed_fraud')) AS confirmed_fraud,
(count(*) FILTER (WHERE ({cond}) AND label = 'false_positive')) AS false_positive FROM b""" for name, cond in RULE_SQL.items())


@query("agg16_rule_backtest", f"""WITH {ALERTS}, {LATEST_FEEDBACK},
b AS (SELECT al.* EXCLUDE (amount), sum_amount_1h AS amount, label FROM al LEFT JOIN lf ON alert_id = id), r AS ({BACKTEST})
SELECT *, round(matched::DOUBLE / total_scanned * 100, 2) AS match_rate,
round(confirmed_fraud::DOUBLE / nullif(confirmed_fraud + false_positive, 0), 3) AS precision_on_labelled FROM r""")
def agg16(spark, folder):
    latest = cases.latest_feedback(tables.feedback(spark, folder))
    return decisions.backtest(tables.alerts(spark, folder), latest, RULES)


@query("agg16_backtest_samples", f"""WITH {ALERTS} SELECT id AS transaction_id, entity_id, risk_label, round(risk_score, 3) AS risk_score
FROM al WHERE device_shift = 1 AND sum_amount_1h > 50 ORDER BY created_at DESC, id LIMIT 8""")
def agg16_samples(spark, folder):
    return decisions.backtest_samples(tables.alerts(spark, folder), RULES[2])


# ---------------------------------------------------------------- scalar functions

@query("sca1_text", f"""SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) || ':' || coalesce(nullif(user_id::VARCHAR, '0'), 'na') AS key
FROM events""")
def sca1(spark, folder):
    events = tables.table(spark, folder, "events")
    noisy = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    owner = F.coalesce(F.nullif(F.col("user_id").cast("string"), F.lit("0")), F.lit("na"))
    return events.select("event_id", F.concat_ws(":", F.lower(F.trim(noisy)), owner).alias("key"))


@query("sca2_blank_normalisation", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'na' WHEN event_type = 'error' THEN ''
ELSE event_type END AS device FROM events""")
def sca2(spark, folder):
    events = tables.table(spark, folder, "events")
    source = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    filled = scalar.replace_exact(scalar.blank_to_empty(source), "", "na")
    return events.select("event_id", scalar.replace_exact(filled, "unknown", "").alias("device"))


@query("sca3_masked_card", """SELECT o_orderkey, o_orderpriority || ' ••••' || right((o_custkey + 1000000)::VARCHAR, 4) || ' debit' AS card
FROM orders""")
def sca3(spark, folder):
    orders = tables.table(spark, folder, "orders")
    number = (F.col("o_custkey") + 1000000).cast("string")
    return orders.select("o_orderkey", scalar.masked_card(F.col("o_orderpriority"), number, F.lit("debit")).alias("card"))


@query("sca4_dates", f"""SELECT event_id, strftime(ts, '%Y%m%d')::INTEGER AS date_key, year(ts) AS y, month(ts) AS m, day(ts) AS d,
dayofweek(ts) + 1 AS dow FROM events""")
def sca4(spark, folder):
    ts = F.timestamp_seconds(F.unix_timestamp(tables.utc("ts")))
    return tables.table(spark, folder, "events").select(
        "event_id", F.date_format(ts, "yyyyMMdd").cast("int").alias("date_key"), F.year(ts).alias("y"), F.month(ts).alias("m"),
        F.dayofmonth(ts).alias("d"), F.dayofweek(ts).alias("dow"))


@query("sca5_day_index", f"WITH {TX} SELECT transaction_id, (t // 86400) AS day FROM tx")
def sca5(spark, folder):
    return tables.transactions(spark, folder).select("transaction_id", scalar.day_index(F.col("event_time_seconds")).alias("day"))


@query("sca6_iso_parse", """SELECT event_id, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-06-01' ELSE ts END AS parsed FROM events""")
def sca6(spark, folder):
    events = tables.table(spark, folder, "events")
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format(tables.utc("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    arrival = F.lit(datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC))
    return tables.ntz(events.select("event_id", scalar.parse_iso(text, arrival).alias("parsed")), "parsed")


@query("sca7_number_or_default", """SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0 ELSE value END AS parsed FROM events""")
def sca7(spark, folder):
    text = F.when(F.col("event_type") == "error", "many").otherwise(F.col("value").cast("string"))
    return tables.table(spark, folder, "events").select("event_id", scalar.number_or(text, 1.0).alias("parsed"))


@query("sca8_clamp", "SELECT event_id, least(greatest(value / 100, 0.01), 0.99) AS clamped FROM events")
def sca8(spark, folder):
    return tables.table(spark, folder, "events").select(
        "event_id", decisions.clamp(F.col("value") / 100, 0.01, 0.99).alias("clamped"))


def _mod_sql(digits: str, modulus: int) -> str:
    step = 2 ** 32 % modulus
    rest = "0"
    for i in range(4):
        rest = f"(({rest} * {step} + CAST('0x' || substr({digits}, {1 + 8 * i}, 8) AS BIGINT)) % {modulus})"
    return rest


@query("sca9_card_proxy", f"""SELECT event_id, {_mod_sql('h', 100000)} + 1 AS card FROM (SELECT event_id,
md5(user_id::VARCHAR || '-' || event_id) AS h FROM events)""")
def sca9(spark, folder):
    name = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return tables.table(spark, folder, "events").select("event_id", scalar.card_proxy(name).alias("card"))


def uuid5_sql(name: str) -> str:
    digest = f"sha1(unhex('{scalar.DNS_NAMESPACE}') || encode({name}))"
    return (f"substr({digest}, 1, 12) || '5' || substr({digest}, 14, 3) || substr('89ab', (strpos('0123456789abcdef', "
            f"substr({digest}, 17, 1)) - 1) % 4 + 1, 1) || substr({digest}, 18, 15)")


CODES = "['US','GB','DE','NG','BR','IN','RU','SG','FR','CN']"


@query("sca10_country", f"""SELECT event_id, {CODES}[{_mod_sql('u', 10)} + 1] AS code FROM (SELECT event_id,
{uuid5_sql("user_id::VARCHAR || '-' || event_id")} AS u FROM events)""")
def sca10(spark, folder):
    name = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return tables.table(spark, folder, "events").select("event_id", scalar.country(name)["code"].alias("code"))


@query("sca11_rounded_rates", """SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 4) AS rate
FROM events GROUP BY user_id""")
def sca11(spark, folder):
    rate = insights.safe_div(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1)))
    return tables.table(spark, folder, "events").groupBy("user_id").agg(F.round(rate, 4).alias("rate"))


@query("sca12_sha256", "SELECT event_id, substr(sha256(props), 1, 16) AS digest FROM events")
def sca12(spark, folder):
    return tables.table(spark, folder, "events").select("event_id", F.substring(F.sha2("props", 256), 1, 16).alias("digest"))


@query("sca13_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type || '|' || user_id AS back FROM events")
def sca13(spark, folder):
    """Parse a map, encode a struct, and decode it again."""
    k = F.from_json("props", "map<string,bigint>")["k"]
    encoded = F.to_json(F.struct("event_type", F.array("user_id").alias("ids")))
    decoded = F.from_json(encoded, "event_type string, ids array<bigint>")
    back = F.concat_ws("|", decoded["event_type"], decoded["ids"][0].cast("string"))
    return tables.table(spark, folder, "events").select("event_id", k.alias("k"), back.alias("back"))


@query("sca14_percent_text", f"WITH {PLAIN_ALERTS} SELECT id, round(risk_score * 100, 1)::VARCHAR || '%' AS text FROM pa")
def sca14(spark, folder):
    return tables.plain_alerts(spark, folder).select("id", scalar.percent_text(F.col("risk_score")).alias("text"))


@query("sca15_array_predicates", f"""WITH {ALERTS} SELECT id, len(list_filter([tx_count_5m, tx_count_1h, tx_count_24h], lambda x: x > 2)) AS above_two,
tx_count_5m > 1 AND tx_count_1h > 1 AND tx_count_24h > 1 AS all_repeat, tx_count_24h > 10 OR tx_count_1h > 10 OR tx_count_5m > 10 AS any_ten
FROM al""")
def sca15(spark, folder):
    counts = F.array("tx_count_5m", "tx_count_1h", "tx_count_24h")
    return tables.alerts(spark, folder).select(
        "id", F.size(F.filter(counts, lambda x: x > 2)).alias("above_two"), F.forall(counts, lambda x: x > 1).alias("all_repeat"),
        F.exists(counts, lambda x: x > 10).alias("any_ten"))


@query("sca16_missing_sentinels", """SELECT event_id, CASE WHEN value < 10 THEN -999.0 ELSE value END AS amount,
CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS device FROM events""")
def sca16(spark, folder):
    rows = tables.table(spark, folder, "events").select(
        "event_id", F.when(F.col("value") >= 10, F.col("value")).alias("amount"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("device"))
    return rows.fillna({"amount": -999.0, "device": "unknown"})


@query("src21_feature_json", f"""WITH {ALERTS} SELECT id, [tx_count_5m::DOUBLE, 0.0, tx_count_24h::DOUBLE, round(sum_amount_1h, 4),
device_shift::DOUBLE] AS features FROM al""")
def src21(spark, folder):
    """Stored JSON without one of its keys."""
    stored = F.to_json(F.struct("tx_count_5m", "tx_count_24h", F.round("sum_amount_1h", 4).alias("sum_amount_1h"), "device_shift"))
    return tables.alerts(spark, folder).select("id", scalar.feature_vector(scalar.parse_features(stored)).alias("features"))
