"""Shared identifiers, components, communities and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import ALERTS
from riskloom.operators import graph
from riskloom.plans import rings
from riskloom.session import materialise
from riskloom.sources import files, tables

ROWS = """buys AS (SELECT o_custkey::VARCHAR AS account, 'dev_' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority AS "Device",
'card_' || l_partkey || '|' || l_quantity::INTEGER AS "Card", 'addr_' || l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS "Address",
l_extendedprice AS amount, (o_custkey * 7919 % 997) / 997 AS risk, (l_returnflag = 'R')::INTEGER AS is_fraud,
date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ent AS (SELECT account, 'Device' AS kind, "Device" AS id FROM buys UNION ALL SELECT account, 'Card', "Card" FROM buys
UNION ALL SELECT account, 'Address', "Address" FROM buys),
uses AS (SELECT account, kind, id, count(*) AS transactions FROM ent GROUP BY ALL),
idents AS (SELECT kind, id, count(*) AS degree FROM uses GROUP BY ALL),
accts AS (SELECT account, count(*) AS transactions, sum(is_fraud)::BIGINT AS fraud_transactions, avg(risk) AS avg_risk, max(risk) AS max_risk,
sum(amount) AS total_amount, min(day) AS first_seen_day, max(day) AS last_seen_day FROM buys GROUP BY 1)"""


def _pairs_sql(max_degree: int) -> str:
    return f"""{ROWS}, keep AS (SELECT u.* FROM uses u JOIN idents i USING (kind, id) WHERE degree BETWEEN 2 AND {max_degree}),
pairs AS (SELECT x.kind, x.id, x.account AS a, y.account AS b FROM keep x JOIN keep y ON x.kind = y.kind AND x.id = y.id AND x.account < y.account),
links AS (SELECT a, b, count(DISTINCT id) AS shared, list_sort(list(DISTINCT kind)) AS kinds FROM pairs GROUP BY a, b
HAVING count(DISTINCT id) >= 2 AND count(DISTINCT kind) >= 2)"""


LINKS = _pairs_sql(20)
RING_SQL = f"""{LINKS}, sym AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT u AS account, u AS r FROM sym UNION SELECT reach.account, sym.v FROM reach JOIN sym ON sym.u = reach.r),
comp AS (SELECT account, min(r) AS component FROM reach GROUP BY account),
memb AS (SELECT *, 'ring-' || component || '-' || component AS ring_id FROM comp),
ring AS (SELECT ring_id, component, component AS community, count(*) AS size, round(avg(avg_risk), 4) AS risk_score, round(max(max_risk), 4) AS peak_risk,
sum(transactions)::BIGINT AS transactions, sum(fraud_transactions)::BIGINT AS fraud_transactions, round(sum(total_amount), 2) AS total_amount
FROM memb JOIN accts USING (account) GROUP BY ALL HAVING count(*) >= 3),
redge AS (SELECT x.ring_id, a AS source, b AS target, shared, kinds FROM links JOIN memb x ON x.account = a),
rident AS (SELECT ring_id, kind, id, count(DISTINCT account) AS accounts FROM keep JOIN memb USING (account) GROUP BY ALL HAVING count(DISTINCT account) >= 2)"""


def _edges(spark, folder):
    return graph.usage(graph.long_form(tables.purchases(spark, folder)))


def _links(spark, folder, max_degree=graph.MAX_DEGREE):
    return graph.links(graph.candidate_pairs(_edges(spark, folder), max_degree))


def _members(spark, folder):
    links = materialise(_links(spark, folder))
    return links, materialise(graph.ring_members(graph.components(links)))


@query("prj5_graph_identifiers", """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS row,
trim(CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_custkey::VARCHAR END) AS card1, l_partkey, l_quantity::INTEGER AS q,
CASE WHEN l_returnflag <> 'N' THEN l_suppkey::VARCHAR ELSE '' END AS addr1, l_linenumber AS addr2, lower(l_linestatus) AS dt,
CASE WHEN l_returnflag = 'A' THEN '' ELSE strftime(l_shipdate, '%Y-%m') END AS di FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT row, 'acct_' || card1 || '_' || CASE WHEN addr1 = '' THEN 'na' ELSE addr1 END AS account,
CASE WHEN di <> '' THEN 'dev_' || dt || '|' || di ELSE '' END AS device, CASE WHEN di <> '' THEN di || ' (' || dt || ')' ELSE '' END AS device_label,
'card_' || card1 || '|' || l_partkey || '||visa|' || q || '|debit' AS card, 'visa ••••' || right(card1, 4) || ' debit' AS card_label,
CASE WHEN addr1 <> '' THEN 'addr_' || addr1 || '|' || addr2 ELSE '' END AS address FROM r WHERE card1 <> ''""")
def prj5(spark, folder):
    found = graph.identify(tables.raw_cards(spark, folder))
    return found.select("row", "account", F.col("Device").alias("device"), F.col("Device_label").alias("device_label"),
                        F.col("Card").alias("card"), F.col("Card_label").alias("card_label"), F.col("Address").alias("address"))


@query("gra1_vertices_edges", f"""WITH {ROWS} SELECT 'Account' AS kind, count(*) AS vertices, sum(transactions)::BIGINT AS weight FROM accts
UNION ALL SELECT kind, count(*), sum(degree)::BIGINT FROM idents GROUP BY kind""")
def gra1(spark, folder):
    rows = tables.purchases(spark, folder)
    accounts = graph.accounts(rows).agg(F.lit("Account").alias("kind"), F.count(F.lit(1)).alias("vertices"), F.sum("transactions").alias("weight"))
    found = graph.identifiers(graph.usage(graph.long_form(rows)))
    return accounts.unionByName(found.groupBy("kind").agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("weight")))


@query("agg4_graph_accounts", f"""WITH {ROWS} SELECT account, transactions, fraud_transactions, round(avg_risk, 6) AS avg_risk, round(max_risk, 9) AS max_risk,
round(total_amount, 2) AS total_amount, first_seen_day, last_seen_day FROM accts""")
def agg4(spark, folder):
    out = graph.accounts(tables.purchases(spark, folder))
    return out.withColumns({"avg_risk": F.round("avg_risk", 6), "max_risk": F.round("max_risk", 9), "total_amount": F.round("total_amount", 2)})


@query("agg5_identifier_degree", f"WITH {ROWS} SELECT kind, id, degree, id AS label FROM idents")
def agg5(spark, folder):
    return graph.identifiers(_edges(spark, folder))


@query("gra2_supernode_filter", f"WITH {ROWS} SELECT u.account, u.kind, u.id, degree FROM uses u JOIN idents USING (kind, id) WHERE degree BETWEEN 2 AND 3")
def gra2(spark, folder):
    return graph.binding(_edges(spark, folder), 3)


@query("jon7_candidate_pairs", f"WITH {LINKS} SELECT kind, id, a, b FROM pairs")
def jon7(spark, folder):
    return graph.candidate_pairs(_edges(spark, folder))


@query("agg6_folded_pairs", f"WITH {_pairs_sql(3)} SELECT a, b, shared, kinds FROM links")
def agg6(spark, folder):
    return _links(spark, folder, 3)


@query("gra3_links", f"WITH {LINKS} SELECT a, b, shared, kinds FROM links")
def gra3(spark, folder):
    return _links(spark, folder)


@query("set5_undirected_edges", f"WITH {LINKS} SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links")
def set5(spark, folder):
    return graph.undirected(_links(spark, folder))


@query("agg7_graph_statistics", f"""WITH {LINKS} SELECT (SELECT count(*) FROM accts) AS accounts, (SELECT sum(transactions)::BIGINT FROM accts) AS transactions,
(SELECT count(*) FROM idents WHERE kind = 'Device') AS devices, (SELECT count(*) FROM idents WHERE kind = 'Card') AS cards,
(SELECT count(*) FROM idents WHERE kind = 'Address') AS addresses, (SELECT count(*) FROM links) AS shared_links""")
def agg7(spark, folder):
    rows = tables.purchases(spark, folder)
    edges = graph.usage(graph.long_form(rows))
    return graph.statistics(graph.accounts(rows), graph.identifiers(edges), graph.links(graph.candidate_pairs(edges)))


@query("gra4_components", f"WITH RECURSIVE {RING_SQL} SELECT account, component FROM comp")
def gra4(spark, folder):
    return graph.components(_links(spark, folder))


@query("gra5_communities")
def gra5(spark, folder):
    links = materialise(_links(spark, folder))
    return graph.communities(links, graph.components(links))


@query("gra5_community_facts", f"""WITH RECURSIVE {RING_SQL} SELECT component, count(*) AS accounts, 0 AS repeated, 0 AS strays, true AS not_worse FROM comp GROUP BY component""")
def gra5_facts(spark, folder):
    """Communities divide components: every account once, none outside its component, modularity at least that of the components."""
    links = materialise(_links(spark, folder))
    components = materialise(graph.components(links))
    found = materialise(graph.communities(links, components))
    whole = components.withColumnRenamed("component", "community")
    least, reached = (graph.modularity(links, places).first().modularity for places in (whole, found))  # one row each
    crossing = components.join(found, "account").groupBy("community").agg(F.min("component").alias("component"), F.countDistinct("component").alias("over"))
    strays = crossing.groupBy("component").agg(F.sum(F.col("over") - 1).alias("strays"))
    per = components.join(found, "account", "left").groupBy("component").agg(
        F.countDistinct("account").alias("accounts"), (F.count(F.lit(1)) - F.countDistinct("account")).alias("repeated"))
    return per.join(strays, "component").select(
        "component", "accounts", F.col("repeated").cast("int"), F.col("strays").cast("int"), F.lit((reached or 0.0) > (least or 0.0) - 1e-9).alias("not_worse"))


@query("gra6_modularity", f"""WITH RECURSIVE {RING_SQL}, p AS (SELECT shared::DOUBLE AS w, x.component AS ca, y.component AS cb FROM links
JOIN comp x ON x.account = a JOIN comp y ON y.account = b), e AS (SELECT ca AS c, w * (ca = cb)::INTEGER AS inside, w FROM p UNION ALL SELECT cb, 0, w FROM p),
g AS (SELECT c, sum(inside) AS i, sum(w) AS d FROM e GROUP BY c) SELECT round(2 * sum(i) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) AS modularity FROM g""")
def gra6(spark, folder):
    links, members = _members(spark, folder)
    return graph.modularity(links, members.select("account", "community")).select(F.round("modularity", 6).alias("modularity"))


@query("agg19_ring_rollup", f"WITH RECURSIVE {RING_SQL} SELECT * FROM ring")
def agg19(spark, folder):
    _, members = _members(spark, folder)
    return graph.rings(members, graph.accounts(tables.purchases(spark, folder)))


@query("top5_top_rings", f"WITH RECURSIVE {RING_SQL} SELECT ring_id, size, risk_score FROM ring ORDER BY risk_score DESC, size DESC, ring_id LIMIT 25")
def top5(spark, folder):
    return graph.top_rings(agg19(spark, folder)).select("ring_id", "size", "risk_score")


@query("jon8_ring_edges", f"WITH RECURSIVE {RING_SQL} SELECT ring_id, source, target, shared, kinds FROM redge")
def jon8(spark, folder):
    links, members = _members(spark, folder)
    return graph.ring_edges(members, links)


def _ring_identifiers(spark, folder):
    edges = materialise(_edges(spark, folder))
    links = materialise(graph.links(graph.candidate_pairs(edges)))
    members = graph.ring_members(graph.components(links))
    return graph.ring_identifiers(members, edges, graph.identifiers(edges))


@query("agg18_shared_kinds", f"""WITH RECURSIVE {RING_SQL} SELECT ring_id, (count(*) FILTER (WHERE kind = 'Device')) AS devices,
(count(*) FILTER (WHERE kind = 'Card')) AS cards, (count(*) FILTER (WHERE kind = 'Address')) AS addresses FROM rident GROUP BY ring_id""")
def agg18(spark, folder):
    kinds = graph.shared_kinds(_ring_identifiers(spark, folder))
    count = lambda kind: F.coalesce(F.col("shared_kinds")[kind], F.lit(0))
    return kinds.select("ring_id", count("Device").alias("devices"), count("Card").alias("cards"), count("Address").alias("addresses"))


DOCUMENT_SQL = f"""WITH RECURSIVE {RING_SQL}, topr AS (SELECT * FROM ring ORDER BY risk_score DESC, size DESC, ring_id LIMIT 25)
SELECT ring_id, size, risk_score, peak_risk, transactions, fraud_transactions, total_amount,
(SELECT list_sort(list(account)) FROM memb m WHERE m.ring_id = t.ring_id) AS accounts,
(SELECT count(*) FROM redge e WHERE e.ring_id = t.ring_id) AS edge_count,
(SELECT list_sort(list(id)) FROM rident i WHERE i.ring_id = t.ring_id) AS identifier_ids FROM topr t"""


def _flat(documents):
    return documents.select(
        "ring_id", "size", "risk_score", "peak_risk", "transactions", "fraud_transactions", "total_amount", "accounts",
        F.size("edges").alias("edge_count"), F.sort_array(F.transform("identifiers", lambda i: i["id"])).alias("identifier_ids"))


@query("gra7_ring_readout", DOCUMENT_SQL)
def gra7(spark, folder):
    return _flat(rings.build(tables.purchases(spark, folder), louvain=False))


@query("src18_ring_snapshot", DOCUMENT_SQL)
def src18(spark, folder):
    path = files.scratch(spark, "rings")
    rings.write_snapshot(rings.build(tables.purchases(spark, folder), louvain=False), path)
    absent = rings.read_snapshot(spark, files.scratch(spark, "absent"))
    return _flat(rings.read_snapshot(spark, path).unionByName(absent))


@query("gra9_ring_parameters", f"""WITH RECURSIVE {RING_SQL.replace('BETWEEN 2 AND 20', 'BETWEEN 2 AND 3')}
SELECT ring_id, size FROM ring WHERE size >= 4 ORDER BY risk_score DESC, size DESC, ring_id LIMIT 10""")
def gra9(spark, folder):
    out = rings.build(tables.purchases(spark, folder), limit=10, min_size=4, max_degree=3, louvain=False)
    return out.select("ring_id", "size")


@query("job2_ring_snapshot")
def job2(spark, folder):
    path = files.scratch(spark, "rings")
    rings.write_snapshot(rings.build(tables.purchases(spark, folder)), path)
    return rings.read_snapshot(spark, path).select("ring_id", "size", "risk_score", "transactions")


# ---------------------------------------------------------------- signature rings

SIGNATURES = f"""{ALERTS}, st AS (SELECT entity_id, count(*) AS flags, (count(*) FILTER (WHERE risk_label = 'FRAUD')) AS fraud, max(risk_score) AS max_score,
(count(*) FILTER (WHERE device_shift = 1)) AS shifts FROM al WHERE risk_label <> 'SAFE' GROUP BY 1),
sr AS (SELECT floor(max_score * 10 + 0.5) AS bucket, min(entity_id) AS ring_id, count(*) AS size, sum(flags)::BIGINT AS flags, sum(fraud)::BIGINT AS fraud,
round(max(max_score), 3) AS risk FROM st WHERE shifts > 0 GROUP BY 1 HAVING count(*) >= 2)"""


def _signatures(spark, folder):
    return graph.signature_stats(tables.alerts(spark, folder))


@query("gra8_signature_rings", f"WITH {SIGNATURES} SELECT ring_id, size, flags, fraud, risk FROM sr")
def gra8(spark, folder):
    return graph.signature_rings(_signatures(spark, folder)).orderBy(F.desc("size"), F.desc("fraud")).drop("bucket")


@query("agg20_signature_nodes", f"""WITH {SIGNATURES} SELECT entity_id, st.flags, st.fraud, round(max_score, 3) AS max_score, ring_id FROM st
LEFT JOIN sr ON shifts > 0 AND bucket = floor(max_score * 10 + 0.5)""")
def agg20(spark, folder):
    stats = _signatures(spark, folder)
    return graph.signature_nodes(stats, graph.signature_rings(stats))
