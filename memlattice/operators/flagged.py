"""Context of flagged nodes: enrichment of subgraphs, neighbours, content twins and the edges among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators.graph import union_all
from memlattice.sources.sinks import materialised

#: Edges that a subgraph's walk does not follow but its detectors need.
EXTRA_PREDICATES = ("abstracts", "supersedes", "subClassOf", "state")
#: Parts that a hot group is first ranked in, each keeping its own first ones.
SALTS = 64


def first_of_each(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key by `order`, ranked in salted parts before, so no task holds a hot key whole."""
    part = F.pmod(F.xxhash64(order), F.lit(SALTS))
    inner = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    some = rows.withColumn("_part", part).withColumn("_n", inner).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most).drop("_n", "_part")


def is_node(column: Column) -> Column:
    """Whether a value is a node's id and not a literal."""
    return X.node_kind(column) != "literal"


def enriched(nodes: DataFrame, edges: DataFrame, store: DataFrame, superseded: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with summary, edges) of subgraphs with what their detectors need.

    `nodes` has center and node, `edges` center, s, p, o as the walk found them.  Added are the store's edges of EXTRA_PREDICATES that
    begin or end in a node of the subgraph, a state only while no sidecar has `superseded` it (s, p, o), and each
    node's summary from `summaries` (node, summary), null where there is none.  Edges of one subgraph are distinct.
    """
    extra = store.where(F.col("p").isin(*EXTRA_PREDICATES)).select("s", "p", "o").distinct()
    extra = extra.join(superseded.where("p = 'state'").select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    inside = nodes.select("center", "node").distinct()
    out = inside.join(extra, F.col("node") == F.col("s")).select("center", "s", "p", "o")
    back = inside.join(extra, F.col("node") == F.col("o")).select("center", "s", "p", "o")
    said = summaries.groupBy("node").agg(F.min("summary").alias("summary"))
    return inside.join(said, "node", "left").select("center", "node", "summary"), edges.select("center", "s", "p", "o").unionByName(out).unionByName(back).distinct()


def flagged_context(flagged: DataFrame, nodes: DataFrame, edges: DataFrame, twins: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each flagged node's context: (center, flag, node, role) and (center, flag, s, p, o).

    `flagged` has center and flag (a node), `nodes` center, node, content, `edges` center, s, p, o.  A context has the flagged node
    (role self), what an edge joins it to (neighbour), and the first `twins` other nodes by id of the same kind and
    the same content (twin).  A node has one role, the first of these.  Its edges are those between its
    nodes and those from them to literals.

    Twins meet by a hash of kind and content, of which `twins` + 1 ids are kept, so no number of equal
    contents is met in pairs.  Nodes without content have no twins; nulls are left out, repeated rows are one.
    """
    asked = materialised(flagged.where("center IS NOT NULL AND flag IS NOT NULL").select("center", "flag").distinct())
    links = edges.where("s IS NOT NULL AND o IS NOT NULL").select("center", "s", "p", "o").distinct()
    ends = links.where(is_node(F.col("s")) & is_node(F.col("o")))
    ahead = asked.withColumnRenamed("flag", "s").join(ends, ["center", "s"]).select("center", F.col("s").alias("flag"), F.col("o").alias("node"))
    behind = asked.withColumnRenamed("flag", "o").join(ends, ["center", "o"]).select("center", F.col("o").alias("flag"), F.col("s").alias("node"))
    near = ahead.unionByName(behind)
    told = nodes.where("node IS NOT NULL AND content IS NOT NULL AND content <> ''").select("center", "node", F.sha2(F.concat_ws("|", X.node_kind(F.col("node")), "content"), 256).alias("_h")).distinct()
    kept = first_of_each(told.withColumn("_key", F.concat_ws("|", "center", "_h")), "_key", "node", twins + 1).select("center", "_h", F.col("node").alias("twin"))
    own = asked.join(told.withColumnRenamed("node", "flag"), ["center", "flag"]).join(kept, ["center", "_h"]).where("twin <> flag")
    nth = F.row_number().over(Window.partitionBy("center", "flag").orderBy("twin"))  # twins + 1 rows at most
    own = own.select("center", "flag", "twin").distinct().withColumn("_n", nth).where(F.col("_n") <= twins).select("center", "flag", F.col("twin").alias("node"))
    roles = union_all([
        asked.select("center", "flag", F.col("flag").alias("node"), F.lit(0).alias("_role")),
        near.select("center", "flag", "node", F.lit(1).alias("_role")),
        own.select("center", "flag", "node", F.lit(2).alias("_role")),
    ])
    names = F.array(F.lit("self"), F.lit("neighbour"), F.lit("twin"))
    members = materialised(roles.groupBy("center", "flag", "node").agg(F.min("_role").alias("_r")).select("center", "flag", "node", F.get(names, F.col("_r")).alias("role")))
    inside = members.select("center", "flag", F.col("node").alias("s")).join(links, ["center", "s"])
    ends_inside = members.select("center", "flag", F.col("node").alias("o"))
    both = inside.where(is_node(F.col("o"))).join(ends_inside, ["center", "flag", "o"], "left_semi")
    return members, both.unionByName(inside.where(~is_node(F.col("o")))).select("center", "flag", "s", "p", "o")
