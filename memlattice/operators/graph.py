"""Graph operators over an edge table (s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised


def out_hop(seeds: DataFrame, edges: DataFrame, predicate: str) -> DataFrame:
    """(node, next): objects of `predicate` from seed nodes."""
    return seeds.join(edges.where(F.col("p") == predicate), F.col("node") == F.col("s")).select("node", F.col("o").alias("next"))


def in_hop(seeds: DataFrame, edges: DataFrame, predicate: str) -> DataFrame:
    """(node, next): subjects of `predicate` into seed nodes."""
    return seeds.join(edges.where(F.col("p") == predicate), F.col("node") == F.col("o")).select("node", F.col("s").alias("next"))


def axis_candidates(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id) of subjects that match every axis a plan asks for.

    `plans` has query_id, predicate, object, need: an axis is satisfied by `need`
    of its objects (1 for a union inside the axis, all of them for an intersection).
    An axis that nothing satisfies leaves its query without candidates.
    """
    wanted = plans.groupBy("query_id").agg(F.countDistinct("predicate").alias("axes"))
    hits = plans.join(edges.select("s", F.col("p").alias("predicate"), F.col("o").alias("object")), ["predicate", "object"])
    met = hits.groupBy("query_id", "s", "predicate").agg(F.countDistinct("object").alias("n"), F.max("need").alias("need")).where("n >= need")
    per_id = met.groupBy("query_id", "s").agg(F.count(F.lit(1)).alias("met"))
    return per_id.join(wanted, "query_id").where("met = axes").select("query_id", F.col("s").alias("id"))


def undirected(edges: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(node, nb) in both directions, distinct."""
    some = edges.where(F.col("p").isin(predicates)) if predicates else edges
    both = some.select(F.col("s").alias("node"), F.col("o").alias("nb")).union(some.select(F.col("o").alias("node"), F.col("s").alias("nb")))
    return both.where("node <> nb").distinct()


def capped(neighbours: DataFrame, cap: int) -> DataFrame:
    """The first `cap` neighbours of each node by id."""
    nth = F.row_number().over(Window.partitionBy("node").orderBy("nb"))
    return neighbours.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")


def bounded_bfs(centers: DataFrame, neighbours: DataFrame, radius: int, both_ways: bool = False) -> DataFrame:
    """(center, node, depth): nodes within `radius` hops of each center, with their least depth.

    All centers advance together: one join and one anti-join per hop.  Each frontier is written, so no hop is
    computed again in the next.  Where `neighbours` has every pair in both directions,
    a step can only lead to the last two frontiers or on, and no older one is read.
    """
    fronts = [materialised(centers.select(F.col("node").alias("center"), "node", F.lit(0).alias("depth")))]
    for hop in range(1, radius + 1):
        step = fronts[-1].join(neighbours, "node").select("center", F.col("nb").alias("node")).distinct()
        met = union_all(fronts[-2:] if both_ways else fronts).select("center", "node")
        fronts.append(materialised(step.join(met, ["center", "node"], "left_anti").withColumn("depth", F.lit(hop))))
    return union_all(fronts)


def chain(start: DataFrame, edges: DataFrame, predicate: str, hops: int) -> DataFrame:
    """(anchor, node, hop) along `predicate` from each anchor, itself at hop 0; a node is entered once."""
    links = edges.where(F.col("p") == predicate).select(F.col("s").alias("node"), F.col("o").alias("nb"))
    return bounded_bfs(start, links, hops).select(F.col("center").alias("anchor"), "node", F.col("depth").alias("hop"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): endpoints counted over all edges."""
    ends = edges.select(F.explode(F.array("s", "o")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def current_edges(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Edges whose sidecar state is current; one without a sidecar is."""
    state = meta.select("s", "p", "o", F.col("state").alias("_state"))
    return edges.join(state, ["s", "p", "o"], "left").where(F.coalesce("_state", F.lit("current")) == "current").drop("_state")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes`."""
    a = nodes.select(F.col("node").alias("s")).distinct()
    b = nodes.select(F.col("node").alias("o")).distinct()
    return edges.join(a, "s", "left_semi").join(b, "o", "left_semi").select("s", "p", "o")


def without_match(edges: DataFrame, predicate: str, nodes: DataFrame) -> DataFrame:
    """Edges of a predicate whose object is no known node."""
    return edges.where(F.col("p") == predicate).join(nodes.select(F.col("node").alias("o")), "o", "left_anti").select("s", "p", "o")


def first_match(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def propagate_labels(links: DataFrame) -> DataFrame:
    """(node, component) of an edge table (s, o): least reachable node id.

    Each round takes the least label among neighbours and then follows that label's
    own label, so chains halve; a round that changes nothing ends it.
    """
    both = materialised(links.select(F.col("s").alias("node"), F.col("o").alias("nb")).union(links.select(F.col("o").alias("node"), F.col("s").alias("nb"))).distinct())
    labels = materialised(both.groupBy("node").agg(F.least(F.col("node"), F.min("nb")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("nb"), "component"), "nb").groupBy("node").agg(F.min("component").alias("_m"))
        least = labels.join(heard, "node", "left").select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_c"))
        after = materialised(least.join(jump, "component", "left").select("node", F.coalesce("_c", "component").alias("component"), "_was"))
        changed = after.where("component <> _was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
