"""Transactions to ring snapshot: identifiers, links, components, communities, read-out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import graph
from riskloom.session import materialise

SNAPSHOT = ("ring_id string, part int, accounts array<string>, edges array<struct<source:string,target:string,shared:bigint,"
            "kinds:array<string>>>, identifiers array<struct<id:string,kind:string,accounts:int,members:array<string>,label:string>>, "
            "component string, community string, size bigint, risk_score double, peak_risk double, transactions bigint, "
            "fraud_transactions bigint, total_amount double, shared_kinds map<string,int>")


def build(rows: DataFrame, limit: int = 25, min_size: int = graph.MIN_RING_SIZE, max_degree: int = graph.MAX_DEGREE,
          louvain: bool = True) -> DataFrame:
    """Ring documents of the riskiest rings."""
    graph.check_parameters(limit, min_size, max_degree)
    edges = graph.labelled(materialise(graph.without_own_labels(graph.usage(graph.long_form(rows)))))
    bound = materialise(graph.binding(edges, max_degree))
    links = materialise(graph.links(graph.pairs(bound)))
    components = materialise(graph.components(links))
    found = graph.communities(links, components) if louvain else None
    members = materialise(graph.ring_members(components, found))
    top = graph.top_rings(graph.rings(members, graph.accounts(rows), min_size), limit)
    touched = materialise(bound.join(members, "account", "left_semi").select("kind", "id").distinct())
    named = graph.identifiers(edges.join(touched, ["kind", "id"], "left_semi"))  # labels of others are not looked up
    identifiers = graph.identifiers_in_use(members, bound, named)
    return graph.ring_documents(top, members, graph.ring_edges(members, links), identifiers)


def write_snapshot(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, min_size: int = graph.MIN_RING_SIZE) -> DataFrame:
    """The snapshot, or no rings when there is none."""
    try:
        found = spark.read.schema(SNAPSHOT).json(path)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT)
    return found.where(found["size"] >= min_size)
