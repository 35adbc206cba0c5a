"""Labels that come in shards put together again, candidate pairs within a budget, groups of a soft assignment.

A subgraph (center) is labelled shard by shard, each with a number.  Tables are long: one row per scored node, per list with its
shard, per node of an assignment; no subgraph is gathered in one row.

Defined results: rows with a null center, shard or node are left out; a shard that scores a node twice counts with its smaller score;
a null score counts as an answer, so a later shard does not replace it, and edges at such a node get no score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.evaluation import placed_values
from memlattice.operators.flagged import is_node


def node_scores(scores: DataFrame) -> DataFrame:
    """(center, node, score) of scores (center, shard, node, score): the shard of the lowest number that has a node decides."""
    known = scores.where("center IS NOT NULL AND shard IS NOT NULL AND node IS NOT NULL")
    first = known.groupBy("center", "node").agg(F.min(F.struct("shard", "score")).alias("_f"))
    return first.select("center", "node", F.col("_f.score").alias("score"))


def edge_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(center, s, p, o, score): the mean of both ends, for distinct edges between nodes that both have a score."""
    scored = nodes.where("score IS NOT NULL")
    end = lambda c: scored.select("center", F.col("node").alias(c), F.col("score").alias(f"_{c}"))
    between = edges.where(is_node(F.col("o"))).select("center", "s", "p", "o").distinct()
    both = between.join(end("s"), ["center", "s"]).join(end("o"), ["center", "o"])
    return both.select("center", "s", "p", "o", ((F.col("_s") + F.col("_o")) / 2).alias("score"))


def shard_costs(records: DataFrame) -> DataFrame:
    """(center, n_records, cost) of records (center, shard, cost); an unknown cost is nothing."""
    return records.where("center IS NOT NULL").groupBy("center").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def joined_lists(records: DataFrame) -> DataFrame:
    """(center, place, item): the lists `items` of records (center, shard, items) one after another by shard, places from 0.

    Only lengths meet by subgraph, in ranges; a shard's items stay where they are.  Lists of one shard must be one row.
    """
    known = records.where("center IS NOT NULL AND shard IS NOT NULL")
    sizes = known.select("center", "shard", F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("_n"))
    starts = placed_values(sizes, "center", "shard", "_n").select("center", "shard", "before")
    items = known.select("center", "shard", F.posexplode("items").alias("_i", "item")).join(starts, ["center", "shard"])
    return items.select("center", (F.col("before") + F.col("_i")).alias("place"), "item")


def pair_candidates(nodes: DataFrame, most: int) -> DataFrame:
    """(center, a, b): of each center's pairs a < b of distinct nodes, in sorted order, the first `most`.

    Nodes are numbered by ranges.  Which numbers make up the first pairs follows from how many nodes a center has, so only those are made.
    """
    placed = placed_values(nodes.where("center IS NOT NULL AND node IS NOT NULL").select("center", "node").distinct(), "center", "node")
    i, n = F.col("before"), F.col("total")
    begun = i * (2 * n - i - 1) / 2  # pairs whose first node comes earlier
    left = placed.where((i + 1 < n) & (i < most)).withColumn("_room", F.lit(most) - begun.cast("long")).where("_room > 0")
    right = placed.where(i <= most).select("center", i.alias("_j"), F.col("node").alias("b"))
    met = left.select("center", F.col("node").alias("a"), F.explode(F.sequence(i + 1, F.least(n - 1, i + F.col("_room")))).alias("_j"))
    return met.join(right, ["center", "_j"]).select("center", "a", "b")


def assigned(weights: DataFrame) -> DataFrame:
    """(center, node, cluster, weight): the heaviest cluster of weights (center, node, weights), the first of equals; rows without weights are left out."""
    top = F.array_max("weights")
    found = weights.select("center", "node", (F.array_position("weights", top) - 1).alias("cluster"), top.alias("weight"))
    return found.where("center IS NOT NULL AND node IS NOT NULL AND weight IS NOT NULL")


def cluster_groups(weights: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(groups, members): clusters (center, cluster, n_episodes, coherence) of `least` episodes or more, and their episodes.

    Coherence is the mean weight of all the cluster's nodes in it, episodes or not.
    """
    rows = assigned(weights)
    is_episode = F.col("node").startswith("ep_")
    groups = rows.groupBy("center", "cluster").agg(F.count_if(is_episode).alias("n_episodes"), F.avg("weight").alias("coherence")).where(F.col("n_episodes") >= least)
    return groups, rows.where(is_episode).join(groups, ["center", "cluster"], "left_semi").select("center", "cluster", "node")
