"""Invariants of links, components, communities and rings."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph
from riskloom.plans import rings
from riskloom.session import materialise
from riskloom.sources import files, tables


def link_table(spark, pairs, weight=2):
    return spark.createDataFrame([(min(a, b), max(a, b), weight, ["Card", "Device"]) for a, b in pairs],
                                 "a string, b string, shared long, kinds array<string>")


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    if shape == "chain":
        pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    elif shape == "star":
        pairs = [("hub", f"n{i:03d}") for i in range(60)]
    else:
        rng = random.Random(3)
        pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(80)], 2))) for _ in range(60)})
    found = {r.account: r.component for r in graph.components(link_table(spark, pairs)).collect()}
    assert found == union_find(pairs)


CLIQUES = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(5) for j in range(i + 1, 5)]
BRIDGED = CLIQUES + [("a0", "b0"), ("b1", "c1")]


@pytest.mark.parametrize("max_local_links", [100_000, 0])
def test_communities_find_bridged_cliques(spark, max_local_links):
    links = link_table(spark, BRIDGED)
    components = graph.components(links)
    found = {r.account: r.community for r in graph.communities(links, components, max_local_links).collect()}
    assert len(found) == 15 and {a: c[0] for a, c in found.items()} == {a: a[0] for a in found}
    table = spark.createDataFrame(list(found.items()), "account string, community string")
    whole = components.select("account", F.col("component").alias("community"))
    q, q_whole = (graph.modularity(links, t).first().modularity for t in (table, whole))
    assert q > 0.5 and abs(q_whole) < 1e-9


def test_no_links(spark):
    links = link_table(spark, [("x", "y")]).limit(0)
    assert graph.components(links).count() == 0
    assert graph.communities(links, graph.components(links)).count() == 0


def test_supernodes_bind_nobody(spark):
    edges = spark.createDataFrame([(f"a{i}", "Card", "hot") for i in range(30)] + [("a1", "Card", "c"), ("a2", "Card", "c")],
                                  "account string, kind string, id string")
    pairs = graph.candidate_pairs(edges, 20).collect()
    assert [(p.id, p.a, p.b) for p in pairs] == [("c", "a1", "a2")]


def test_two_kinds_are_needed(spark):
    same = spark.createDataFrame([("Card", "1", "a", "b"), ("Card", "2", "a", "b"), ("Card", "3", "c", "d"), ("Device", "4", "c", "d")],
                                 "kind string, id string, a string, b string")
    assert [(r.a, r.b, r.shared, r.kinds) for r in graph.links(same).collect()] == [("c", "d", 2, ["Card", "Device"])]


@pytest.fixture(scope="module")
def documents(spark):
    rows = tables.purchases(spark, "/root/testdata/sf0.01")
    return materialise(rings.build(rows, limit=10)).collect()


def test_ring_invariants(documents):
    assert 0 < len(documents) <= 10
    for ring in documents:
        assert ring.size == len(ring.accounts) >= 3
        assert 0 <= ring.risk_score <= ring.peak_risk <= 1
        assert ring.fraud_transactions <= ring.transactions
        members = set(ring.accounts)
        for edge in ring.edges:
            assert edge.shared >= 2 and len(edge.kinds) >= 2 and {edge.source, edge.target} <= members
        for identifier in ring.identifiers:
            assert 2 <= identifier.accounts <= 20 and set(identifier.members) <= members
        assert sum(ring.shared_kinds.values()) == len(ring.identifiers)


def test_large_rings_come_in_parts(spark):
    links = link_table(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(50)])
    members = graph.ring_members(graph.components(links))
    edges = graph.ring_edges(members, links)
    table = members.groupBy("ring_id", "component", "community").agg(F.count(F.lit(1)).alias("size"))
    none = spark.createDataFrame([], "kind string, id string, ring_id string, members array<string>, accounts int, label string")
    parts = graph.ring_documents(table, members, edges, none, max_items=10).collect()
    assert len(parts) > 1 and all(len(p.accounts) < 40 for p in parts)
    assert sorted(a for p in parts for a in p.accounts) == [f"n{i:03d}" for i in range(51)]
    assert sum(len(p.edges) for p in parts) == 50


def test_absent_snapshot_is_empty(spark):
    assert rings.read_snapshot(spark, files.scratch(spark, "none")).count() == 0


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 201}, {"min_size": 1}, {"min_size": 51}, {"max_degree": 1}, {"max_degree": 1001}])
def test_parameter_ranges(bad):
    with pytest.raises(ValueError):
        graph.check_parameters(**bad)


@pytest.mark.parametrize("max_local_links", [100_000, 0])
def test_communities_settle_or_fail(spark, max_local_links):
    links = link_table(spark, BRIDGED)
    with pytest.raises(Exception, match="did not settle"):
        graph.communities(links, graph.components(links), max_local_links, rounds=1).collect()


def test_communities_do_not_depend_on_where_the_rounds_run(spark):
    """Random graphs of several components: equal communities for every limit, and no node gains by a move."""
    rng = random.Random(5)
    pairs = {tuple(sorted((f"{c}{rng.randrange(11):02d}", f"{c}{rng.randrange(11):02d}"))) for c in "ab" for _ in range(20)}
    rows = [(a, b, rng.randint(1, 3)) for a, b in sorted(pairs) if a != b]
    links = spark.createDataFrame(rows, "a string, b string, shared bigint")
    components = materialise(graph.components(links))
    results = [{r.account: r.community for r in graph.communities(links, components, limit).collect()} for limit in (100_000, 0)]
    assert results[0] == results[1]
    found, total = results[0], 2 * sum(w for _, _, w in rows)
    degree = {n: sum(w for a, b, w in rows if n in (a, b)) for n in found}

    def quality(place):
        volume = {c: sum(degree[n] for n in place if place[n] == c) for c in set(place.values())}
        return total * 2 * sum(w for a, b, w in rows if place[a] == place[b]) - sum(v * v for v in volume.values())

    # every merge of two communities that touch would lower modularity or leave it
    for x, y in {(found[a], found[b]) for a, b, _ in rows if found[a] != found[b]}:
        assert quality({n: x if c == y else c for n, c in found.items()}) <= quality(found)


def test_a_settled_level_has_no_gainful_move():
    """On a path, where neighbours want to change places, every node ends where no single move raises modularity."""
    edges = [e for i in range(40) for e in ((i, i + 1, 1), (i + 1, i, 1))]
    place = graph._settle(edges, 80, 200)

    def quality(place):
        volume: dict = {}
        for n, c in place.items():
            volume[c] = volume.get(c, 0) + 2 - (n in (0, 40))
        return graph._quality(edges, place, volume, 80)

    assert quality(place) > quality({n: n for n in place})
    for u, v, _ in edges:
        assert quality(place | {u: place[v]}) <= quality(place)


def test_edges_keep_their_labels_and_stored_tables_leave_no_shuffle_files(spark):
    """Labels equal to the id, others, both for one edge, and nulls; a stored table's shuffle files go with its write."""
    import os
    from riskloom import session
    rows = [("a", "x", "x"), ("a", "x", "b"), ("a", "y", "y"), ("a", "y", "z"), ("b", "x", None), ("b", "x", "x"), ("b", "y", None), ("c", "z", "z"), ("c", None, None)]
    long = spark.createDataFrame(rows, "account string, id string, label string").withColumn("kind", F.lit("Device")).repartition(3)
    edges = graph.usage(long)
    assert edges.columns == ["account", "kind", "id", "transactions", "label"]
    want = {}
    for a, i, label in rows:
        want.setdefault((a, i), []).append(label)
    want = {k: (len(v), min((x for x in v if x is not None), default=None)) for k, v in want.items()}
    files_of = lambda: {f for d, _, fs in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for f in fs if f.startswith("shuffle_")}
    before = files_of()
    stored = session.materialise(graph.without_own_labels(edges))
    assert not files_of() - before
    assert stored.where("own_label AND label IS NOT NULL").count() == 0
    for found in (edges, graph.labelled(stored)):
        assert {(r.account, r.id): (r.transactions, r.label) for r in found.collect()} == want
