"""Accounts that share identifiers: vertices, links, components, communities and rings.

Long tables carry everything: usage edges (account, kind, id), links (a, b), members (account, component). No
group is ever gathered whole, except identifiers below the degree bound and small components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalar import blank_to_empty, masked_card, replace_exact
from riskloom.operators.insights import is_label
from riskloom.session import materialise

MIN_SHARED, MIN_KINDS, MIN_RING_SIZE, MAX_DEGREE = 2, 2, 3, 20
KINDS = ("Device", "Card", "Address")


def check_parameters(limit: int = 25, min_size: int = MIN_RING_SIZE, max_degree: int = MAX_DEGREE) -> None:
    for name, value, low, high in (("limit", limit, 1, 200), ("min_size", min_size, 2, 50), ("max_degree", max_degree, 2, 1000)):
        if not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")


# ---------------------------------------------------------------- vertices and edges

def identify(raw: DataFrame) -> DataFrame:
    """Account and identifier keys with labels; rows without ``card1`` are dropped, empty keys mean no identifier."""
    card = [blank_to_empty(F.col(f"card{i}")) for i in range(1, 7)]
    addr1, addr2 = blank_to_empty(F.col("addr1")), blank_to_empty(F.col("addr2"))
    kind = replace_exact(blank_to_empty(F.col("DeviceType")), "unknown", "")
    info = replace_exact(blank_to_empty(F.col("DeviceInfo")), "unknown", "")
    return raw.where(card[0] != "").withColumns({
        "account": F.concat(F.lit("acct_"), card[0], F.lit("_"), replace_exact(addr1, "", "na")),
        "Device": F.when(info != "", F.concat(F.lit("dev_"), kind, F.lit("|"), info)).otherwise(""),
        "Device_label": F.when(info != "", F.concat(info, F.lit(" ("), kind, F.lit(")"))).otherwise(""),
        "Card": F.concat(F.lit("card_"), F.concat_ws("|", *card)),
        "Card_label": masked_card(card[3], card[0], card[5]),
        "Address": F.when(addr1 != "", F.concat(F.lit("addr_"), addr1, F.lit("|"), addr2)).otherwise(""),
        "Address_label": F.when(addr1 != "", F.concat(F.lit("addr "), addr1, F.lit(" / "), replace_exact(addr2, "", "—"))).otherwise(""),
    })


def long_form(rows: DataFrame) -> DataFrame:
    """One row per (transaction, identifier): account, kind, id, label."""
    entries = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("id"), F.col(f"{k}_label").alias("label")) for k in KINDS]
    return rows.select("account", F.inline(F.array(*entries))).where(F.col("id") != "")


def accounts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("is_fraud").alias("fraud_transactions"), F.avg("risk").alias("avg_risk"),
        F.max("risk").alias("max_risk"), F.sum("amount").alias("total_amount"), F.min("day").alias("first_seen_day"),
        F.max("day").alias("last_seen_day"))


def usage(long: DataFrame) -> DataFrame:
    """Edges account -> identifier with transaction counts. A label that is the id itself is not moved beside it."""
    own = F.col("label").eqNullSafe(F.col("id"))
    marked = long.select("account", "kind", "id", own.alias("_own"), F.when(~own, F.col("label")).alias("_label"))
    edges = marked.groupBy("account", "kind", "id").agg(
        F.count(F.lit(1)).alias("transactions"), F.max("_own").alias("_own"), F.min("_label").alias("_label"))
    return edges.select("account", "kind", "id", "transactions", F.least("_label", F.when(F.col("_own"), F.col("id"))).alias("label"))


def without_own_labels(edges: DataFrame) -> DataFrame:
    """Edges to be stored: labels that repeat the id as a flag."""
    own = F.col("label").eqNullSafe(F.col("id"))
    return edges.withColumns({"own_label": own, "label": F.when(~own, F.col("label"))})


def labelled(stored: DataFrame) -> DataFrame:
    """The edges of ``without_own_labels``."""
    return stored.withColumn("label", F.when(F.col("own_label"), F.col("id")).otherwise(F.col("label"))).drop("own_label")


def identifiers(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("degree"), F.min("label").alias("label"))


def binding(edges: DataFrame, max_degree: int = MAX_DEGREE) -> DataFrame:
    """Edges of identifiers with a degree in [2, max_degree].

    Only max_degree + 1 edges per identifier survive the map side, so a supernode is recognised without moving it.
    """
    per = Window.partitionBy("kind", "id")
    few = edges.select("account", "kind", "id").withColumn("_rank", F.row_number().over(per.orderBy("account")))
    few = few.where(F.col("_rank") <= max_degree + 1)
    return few.withColumn("degree", F.count(F.lit(1)).over(per)).where(F.col("degree").between(2, max_degree)).drop("_rank")


def candidate_pairs(edges: DataFrame, max_degree: int = MAX_DEGREE) -> DataFrame:
    """(kind, id, a, b) with a < b as text; at most max_degree * (max_degree - 1) / 2 pairs per identifier."""
    return pairs(binding(edges, max_degree))


def pairs(bound: DataFrame) -> DataFrame:
    """The candidate pairs of the edges that ``binding`` leaves."""
    groups = bound.groupBy("kind", "id").agg(F.sort_array(F.collect_list("account")).alias("m"))
    size = F.size("m")
    both = F.flatten(F.transform("m", lambda a, i: F.transform(
        F.slice("m", i + 2, size), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return groups.select("kind", "id", F.inline(both))


def links(pairs: DataFrame, min_shared: int = MIN_SHARED, min_kinds: int = MIN_KINDS) -> DataFrame:
    folded = pairs.groupBy("a", "b").agg(
        F.count_distinct("id").alias("shared"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return folded.where((F.col("shared") >= min_shared) & (F.size("kinds") >= min_kinds))


def undirected(link_table: DataFrame) -> DataFrame:
    """Each link both ways, once."""
    forward = link_table.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return forward.union(forward.select("v", "u")).distinct()


def statistics(account_table: DataFrame, identifier_table: DataFrame, link_table: DataFrame) -> DataFrame:
    """Vertex, transaction and link counts in one row."""
    a = account_table.select(F.lit("accounts").alias("what"), F.lit(1).alias("n"))
    t = account_table.select(F.lit("transactions").alias("what"), F.col("transactions").alias("n"))
    i = identifier_table.select(F.col("kind").alias("what"), F.lit(1).alias("n"))
    s = link_table.select(F.lit("shared_links").alias("what"), F.lit(1).alias("n"))
    names = {"accounts": "accounts", "transactions": "transactions", "Device": "devices", "Card": "cards",
             "Address": "addresses", "shared_links": "shared_links"}
    counted = a.union(t).union(i).union(s).groupBy("what").agg(F.sum("n").alias("n"))
    return counted.agg(*[F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(v) for k, v in names.items()])


# ---------------------------------------------------------------- components

def components(link_table: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(account, component) with the smallest account as component, by alternating large-star and small-star steps
    (Kiveris et al., 2014). The number of rounds grows with the logarithm of the graph, not with its diameter."""
    edges = materialise(link_table.select(F.col("a").alias("u"), F.col("b").alias("v")))
    signature = None
    for _ in range(max_rounds):
        edges = materialise(_small_star(_large_star(edges)))
        found = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == signature:
            break
        signature = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("account"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("account"), F.col("v").alias("component")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = edges.union(edges.select("v", "u"))
    smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them; edges already point downwards."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest).distinct()


# ---------------------------------------------------------------- communities

def modularity(link_table: DataFrame, communities: DataFrame) -> DataFrame:
    """Q over weighted links; ``communities`` is (account, community)."""
    of = lambda name: communities.select(F.col("account").alias(name), F.col("community").alias(f"c_{name}"))
    placed = link_table.select("a", "b", F.col("shared").cast("double").alias("w")).join(of("a"), "a").join(of("b"), "b")
    ends = F.array(F.struct(F.col("c_a").alias("c"), (F.col("w") * (F.col("c_a") == F.col("c_b")).cast("int")).alias("inside"), F.col("w").alias("w")),
                   F.struct(F.col("c_b").alias("c"), F.lit(0.0).alias("inside"), F.col("w").alias("w")))
    per = placed.select(F.inline(ends)).groupBy("c").agg(F.sum("inside").alias("inside"), F.sum("w").alias("degree"))
    sums = per.agg(F.sum("degree").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("d2"))
    return sums.select((2 * F.col("inside") / F.col("m2") - F.col("d2") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _quality(edges: list, place: dict, volume: dict, total: int) -> int:
    """Modularity times the square of ``total``, a whole number; ``edges`` holds both directions."""
    return total * sum(w for u, v, w in edges if place[u] == place[v]) - sum(x * x for x in volume.values())


def _settle(edges: list, total: int, rounds: int) -> dict:
    """The rounds of ``_distributed`` on one level of one component, inside a task."""
    degree, near = {}, {}
    for u, v, w in edges:
        degree[u] = degree.get(u, 0) + w
        if u != v:
            near.setdefault(u, []).append((v, w))
    place, volume = {n: n for n in degree}, dict(degree)
    quality = _quality(edges, place, volume, total)

    def after(moves):
        new, size = dict(place), dict(volume)
        for _, n, target in moves:
            size[new[n]] -= degree[n]
            size[target] += degree[n]
            new[n] = target
        return new, size, _quality(edges, new, size, total)

    for number in range(rounds):
        wanted = []
        for n, k in degree.items():
            home, inside = place[n], {place[n]: 0}
            for v, w in near.get(n, ()):
                inside[place[v]] = inside.get(place[v], 0) + w
            gain = {c: x * total - (volume[c] - (k if c == home else 0)) * k for c, x in inside.items()}
            best = min(gain, key=lambda c: (-gain[c], c != home, c))
            if best != home:
                wanted.append((gain[home] - gain[best], n, best))
        if not wanted:
            return place
        found = after([m for m in wanted if (m[2] < place[m[1]]) == (number % 2 == 0)])
        if found[2] <= quality:
            first: dict = {}
            for m in sorted(wanted):
                first.setdefault(place[m[1]], m)
                first.setdefault(m[2], m)
            found = after([m for m in wanted if first[place[m[1]]] is m and first[m[2]] is m])
        place, volume, quality = found
    raise RuntimeError(f"communities did not settle in {rounds} rounds of a level")


def _one_component(total: int, rounds: int):
    """Louvain on the links of one component: moves, then the same on merged communities."""
    def communities(pdf):
        import pandas as pd

        edges = [e for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist()) for e in ((a, b, w), (b, a, w))]
        member = {u: u for u, _, _ in edges}
        while True:
            place = _settle(edges, total, rounds)
            member = {n: place[c] for n, c in member.items()}
            if all(n == c for n, c in place.items()):
                break
            merged: dict = {}
            for u, v, w in edges:
                key = place[u], place[v]
                merged[key] = merged.get(key, 0) + w
            edges = [(u, v, w) for (u, v), w in merged.items()]
        names: dict = {}
        for n, c in member.items():
            names[c] = min(n, names.get(c, n))
        return pd.DataFrame([(n, names[c]) for n, c in sorted(member.items())], columns=["account", "community"])
    return communities


def communities(link_table: DataFrame, component_table: DataFrame, max_local_links: int = 100_000,
                rounds: int = 200) -> DataFrame:
    """(account, community), a refinement of the components, by Louvain with weight = shared identifiers.

    Every component goes through the same rounds, all in whole numbers. Each node names the neighbouring community with the
    largest gain (ties: its own, then the smallest). In even rounds the moves to smaller names are made together, in odd ones
    those to larger names, if that raises the component's modularity; otherwise only moves that share no community with a better one,
    whose gains add up. So every round raises modularity, and a level ends when no node gains by a move. ``max_local_links`` decides
    only where the rounds run: components with at most that many links one per task, larger ones as joins; the result is
    the same. A level that has not settled in ``rounds`` rounds raises an error.
    """
    weighted = link_table.select("a", "b", F.col("shared").cast("long").alias("w"))
    placed = weighted.join(component_table.select(F.col("account").alias("a"), "component"), "a")
    sized = placed.join(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n_links")), "component")
    sized = materialise(sized)
    total = sized.agg(F.sum("w")).first()[0]
    schema = f"account {dict(link_table.dtypes)['a']}, community {dict(link_table.dtypes)['a']}"
    if total is None:
        return link_table.sparkSession.createDataFrame([], schema)
    small = sized.where(F.col("n_links") <= max_local_links).select("component", "a", "b", "w")
    out = small.groupBy("component").applyInPandas(_one_component(2 * total, rounds), schema)
    large = sized.where(F.col("n_links") > max_local_links)
    return out.unionByName(_distributed(large, 2 * total, rounds)) if large.take(1) else out


def _distributed(edges: DataFrame, total: int, rounds: int, levels: int = 50) -> DataFrame:
    """Louvain rounds as joins and aggregations; merged communities are the nodes of the next level."""
    level = materialise(edges.select("component", F.col("a").alias("u"), F.col("b").alias("v"), "w").union(
        edges.select("component", F.col("b").alias("u"), F.col("a").alias("v"), "w")))
    member = level.select(F.col("u").alias("account"), F.col("u").alias("node")).distinct()
    for _ in range(levels):
        state = materialise(level.groupBy("component", F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")))
        quality = materialise(_qualities(level, state, total))
        for number in range(rounds):
            wanted = materialise(_wanted(level, state, total))
            if wanted.isEmpty():
                break
            down = F.col("target") < F.col("home")
            state, quality = _accepted(level, state, quality, wanted, down if number % 2 == 0 else ~down, total)
        else:
            raise RuntimeError(f"communities did not settle in {rounds} rounds of a level")
        member = materialise(member.join(state, "node").select("account", F.col("community").alias("node")))
        if state.where("node <> community").isEmpty():
            break
        level = materialise(_placed(level, state).groupBy("component", F.col("c_u").alias("u"), F.col("c_v").alias("v")).agg(F.sum("w").alias("w")))
    else:
        raise RuntimeError(f"communities did not settle in {levels} levels")
    names = member.groupBy("node").agg(F.min("account").alias("community"))
    return member.join(names, "node").select("account", "community")


def _whole(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _placed(level: DataFrame, state: DataFrame) -> DataFrame:
    of = lambda name: state.select(F.col("node").alias(name), F.col("community").alias(f"c_{name}"))
    return level.join(of("u"), "u").join(of("v"), "v")


def _qualities(level: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(component, quality): the component's share of modularity times the square of ``total``."""
    inside = _placed(level, state).where("c_u = c_v").groupBy("component").agg((_whole(F.sum("w")) * _whole(F.lit(total))).alias("part"))
    volume = state.groupBy("component", "community").agg(_whole(F.sum("k")).alias("volume"))
    volume = volume.groupBy("component").agg((-F.sum(F.col("volume") * F.col("volume"))).alias("part"))
    return inside.unionByName(volume).groupBy("component").agg(F.sum("part").alias("quality"))


def _wanted(level: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(component, node, home, target, gain) of the nodes that gain by a move."""
    volume = state.groupBy("community").agg(F.sum("k").alias("volume"))
    reach = level.where("u <> v").join(state.select(F.col("node").alias("v"), "community"), "v").select(
        F.col("u").alias("node"), "community", F.col("w").alias("inside"))
    home = state.select("node", "community", F.lit(0).cast("long").alias("inside"))
    options = reach.union(home).groupBy("node", "community").agg(F.sum("inside").alias("inside"))
    options = options.join(volume, "community").join(state.select("component", "node", "k", F.col("community").alias("home")), "node")
    stays = F.col("community") == F.col("home")
    others = F.col("volume") - F.when(stays, F.col("k")).otherwise(F.lit(0))
    gain = _whole(F.col("inside")) * _whole(F.lit(total)) - _whole(others) * _whole(F.col("k"))
    best = F.min_by("community", F.struct((-F.col("gain")).alias("g"), (~stays).cast("int").alias("s"), F.col("community")))
    chosen = options.withColumn("gain", gain).groupBy("node").agg(
        F.first("component").alias("component"), F.first("home").alias("home"), best.alias("target"),
        (F.max("gain") - F.max(F.when(stays, F.col("gain")))).alias("gain"))
    return chosen.where("target <> home")


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    out = state.join(moves.select("node", "target"), "node", "left")
    return out.select("component", "node", "k", F.coalesce("target", "community").alias("community"))


def _accepted(level: DataFrame, state: DataFrame, quality: DataFrame, wanted: DataFrame, direction: Column, total: int) -> tuple[DataFrame, DataFrame]:
    """State and quality after a round: the moves in one direction where they help the component, exclusive ones elsewhere."""
    together = wanted.where(direction)
    after = _qualities(level, _moved(state, together), total).withColumnRenamed("quality", "after")
    helped = materialise(after.join(quality, "component").where("after > quality").select("component"))
    rest = wanted.join(helped, "component", "left_anti")
    touched = rest.select("node", "gain", F.explode(F.array("home", "target")).alias("touched"))
    first = touched.groupBy("touched").agg(F.min_by("node", F.struct((-F.col("gain")).alias("g"), F.col("node"))).alias("node"))
    alone = first.groupBy("node").agg(F.count(F.lit(1)).alias("times")).where("times = 2").select("node")
    moves = together.join(helped, "component", "left_semi").unionByName(rest.join(alone, "node", "left_semi").select(*wanted.columns))
    state = materialise(_moved(state, moves))
    return state, materialise(_qualities(level, state, total))


# ---------------------------------------------------------------- rings

def ring_members(component_table: DataFrame, community_table: DataFrame | None = None) -> DataFrame:
    """(account, component, community, ring_id); without communities a component is its own community."""
    if community_table is None:
        members = component_table.withColumn("community", F.col("component"))
    else:
        members = component_table.join(community_table, "account")
    return members.withColumn("ring_id", F.concat_ws("-", F.lit("ring"), "component", "community"))


def rings(members: DataFrame, account_table: DataFrame, min_size: int = MIN_RING_SIZE) -> DataFrame:
    """Roll-up per ring: size, mean and peak risk, transactions, fraud and amount."""
    out = members.join(account_table, "account").groupBy("ring_id", "component", "community").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg(F.coalesce("avg_risk", F.lit(0.0))), 4).alias("risk_score"),
        F.round(F.max(F.coalesce("max_risk", F.lit(0.0))), 4).alias("peak_risk"), F.sum("transactions").alias("transactions"),
        F.sum("fraud_transactions").alias("fraud_transactions"), F.round(F.sum("total_amount"), 2).alias("total_amount"))
    return out.where(F.col("size") >= min_size)


def top_rings(ring_table: DataFrame, limit: int = 25) -> DataFrame:
    return ring_table.orderBy(F.desc("risk_score"), F.desc("size"), "ring_id").limit(limit)


def ring_edges(members: DataFrame, link_table: DataFrame) -> DataFrame:
    """Links inside a ring: ring_id, source, target, shared, kinds."""
    end = lambda name: members.select(F.col("account").alias(name), F.col("ring_id").alias(f"ring_{name}"))
    inside = link_table.join(end("a"), "a").join(end("b"), "b").where("ring_a = ring_b")
    return inside.select(F.col("ring_a").alias("ring_id"), F.col("a").alias("source"), F.col("b").alias("target"), "shared", "kinds")


def ring_identifiers(members: DataFrame, edges: DataFrame, identifier_table: DataFrame, max_degree: int = MAX_DEGREE) -> DataFrame:
    """Identifiers that at least two members of a ring use; the member list is bounded by the degree."""
    return identifiers_in_use(members, binding(edges, max_degree), identifier_table)


def identifiers_in_use(members: DataFrame, bound: DataFrame, identifier_table: DataFrame) -> DataFrame:
    """``ring_identifiers`` from the edges that ``binding`` leaves."""
    used = bound.join(members.select("account", "ring_id"), "account")
    touched = used.groupBy("ring_id", "kind", "id").agg(F.sort_array(F.collect_set("account")).alias("members"))
    touched = touched.where(F.size("members") >= 2).withColumn("accounts", F.size("members"))
    return touched.join(identifier_table.select("kind", "id", F.coalesce("label", "id").alias("label")), ["kind", "id"])


def shared_kinds(ring_identifier_table: DataFrame) -> DataFrame:
    """Map kind -> number of identifiers per ring."""
    counted = ring_identifier_table.groupBy("ring_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("kind", "n")))
    return counted.groupBy("ring_id").agg(F.map_from_entries(entries).alias("shared_kinds"))


def _in_parts(rows: DataFrame, item: Column, name: str, max_items: int) -> DataFrame:
    """Arrays of about ``max_items`` items: a ring with more gets several parts, picked by the hash of the item."""
    counted = rows.groupBy("ring_id").agg(F.ceil(F.count(F.lit(1)) / max_items).alias("_parts"))
    placed = rows.select("ring_id", item.alias("_item")).join(counted, "ring_id")
    part = F.pmod(F.xxhash64("_item"), F.col("_parts")).cast("int")
    return placed.groupBy("ring_id", part.alias("part")).agg(F.sort_array(F.collect_list("_item")).alias(name))


def ring_documents(ring_table: DataFrame, members: DataFrame, ring_edge_table: DataFrame, ring_identifier_table: DataFrame,
                   max_items: int = 10_000) -> DataFrame:
    """Nested read-out, one row per ring; rings with more than ``max_items`` members, edges or identifiers continue in
    further parts, so nothing is cut off and no row grows without bound."""
    kept = ring_table.select("ring_id")
    edge = F.struct("source", "target", "shared", "kinds")
    identifier = F.struct("id", "kind", "accounts", "members", "label")
    parts = _in_parts(members.join(kept, "ring_id", "left_semi"), F.col("account"), "accounts", max_items)
    for rows, item, name in ((ring_edge_table, edge, "edges"), (ring_identifier_table, identifier, "identifiers")):
        parts = parts.join(_in_parts(rows.join(kept, "ring_id", "left_semi"), item, name, max_items), ["ring_id", "part"], "full")
    types = dict(parts.dtypes)
    filled = {c: F.coalesce(F.col(c), F.array().cast(types[c])) for c in ("accounts", "edges", "identifiers")}
    return parts.withColumns(filled).join(ring_table, "ring_id").join(shared_kinds(ring_identifier_table), "ring_id", "left")


# ---------------------------------------------------------------- signature rings

def signature_stats(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Flags, fraud, highest score and shifts per entity over non-safe alerts (the newest ``limit`` if given)."""
    flagged = alerts.where(~is_label("SAFE"))
    if limit:
        flagged = flagged.orderBy(F.desc("created_at"), "id").limit(limit)
    return flagged.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("flags"), F.count_if(is_label("FRAUD")).alias("fraud"), F.max("risk_score").alias("max_score"),
        F.count_if(F.col("device_shift") == 1).alias("shifts"))


def signature_rings(stats: DataFrame, min_cluster: int = 2) -> DataFrame:
    """Entities with shifts whose highest scores fall into the same tenth form a ring named after its first entity."""
    bucket = F.floor(F.col("max_score") * 10 + 0.5)
    grouped = stats.where("shifts > 0").groupBy(bucket.alias("bucket")).agg(
        F.min("entity_id").alias("ring_id"), F.count(F.lit(1)).alias("size"), F.sum("flags").alias("flags"),
        F.sum("fraud").alias("fraud"), F.round(F.max("max_score"), 3).alias("risk"))
    return grouped.where(F.col("size") >= min_cluster)


def signature_nodes(stats: DataFrame, ring_table: DataFrame) -> DataFrame:
    """Every entity with its ring or null; there are at most eleven rings, one per score bucket."""
    bucket = F.when(F.col("shifts") > 0, F.floor(F.col("max_score") * 10 + 0.5))
    rings_by_bucket = F.broadcast(ring_table.select("bucket", "ring_id"))
    return stats.withColumn("bucket", bucket).join(rings_by_bucket, "bucket", "left").select(
        "entity_id", "flags", "fraud", F.round("max_score", 3).alias("max_score"), "ring_id")
