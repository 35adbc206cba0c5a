"""Semantic memories, supersession, resolution of endpoints, corruption for round trips, tiny-section merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.evaluation import hash_order, placed_values
from memlattice.sources.sinks import materialised


def create_abstracts(groups: DataFrame, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) of source groups (group, source, text): one memory per group that abstracts its sources."""
    g = groups.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("source", F.substring("text", 1, 512).alias("text")))).alias("_s"))
    names = placed_values(groups.select(F.lit(0).alias("_all"), "group").distinct(), "_all", "group")
    m = g.join(names.select("group", F.format_string("M:%04d", F.col("before") + first).alias("memory")), "group")
    memories = m.select("memory", F.array_join(F.transform("_s", lambda x: x["text"]), "\n").alias("summary"), F.size("_s").alias("n"))
    return memories, m.select(F.col("memory").alias("s"), F.lit("abstracts").alias("p"), F.explode(F.transform("_s", lambda x: x["source"])).alias("o"))


def supersede(episodes: DataFrame, pairs: DataFrame, when: Column) -> tuple[DataFrame, DataFrame]:
    """(episodes, edges) after new episodes supersede old ones; `pairs` has new and old."""
    old = pairs.select(F.col("old").alias("id"), when.alias("_when")).dropDuplicates(["id"])
    closed = episodes.join(old, "id", "left")
    closed = closed.withColumn("state", F.when(F.col("_when").isNotNull(), "superseded").otherwise(F.col("state")))
    closed = closed.withColumn("validity_end", F.coalesce("_when", "validity_end")).drop("_when")
    forward = pairs.select(F.col("new").alias("s"), F.lit("supersedes").alias("p"), F.col("old").alias("o"))
    back = pairs.select(F.col("old").alias("s"), F.lit("superseded_by").alias("p"), F.col("new").alias("o"))
    return closed, forward.union(back)


def archive(edges: DataFrame, doomed: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): edges in `doomed` move, with a reason, from the graph to the archive."""
    keys = doomed.select("s", "p", "o").distinct()
    return edges.join(keys, ["s", "p", "o"], "left_anti"), edges.join(keys, ["s", "p", "o"], "left_semi").withColumn("reason", F.lit(reason))


def resolve_endpoints(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node): the node of that id, else the first with that bare name; null where there is none."""
    exact = nodes.select(F.col("node").alias("name"), F.col("node").alias("_exact")).distinct()
    bare = nodes.groupBy(F.regexp_replace("node", "^(E|T|A|D|S|U|M):", "").alias("name")).agg(F.min("node").alias("_bare"))
    return names.join(exact, "name", "left").join(bare, "name", "left").select("name", F.coalesce("_exact", "_bare").alias("node"))


def edge_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean of both endpoints' scores; edges with an unscored end are left out."""
    a = scores.select(F.col("node").alias("s"), F.col("score").alias("_a"))
    b = scores.select(F.col("node").alias("o"), F.col("score").alias("_b"))
    return edges.join(a, "s").join(b, "o").select("s", "p", "o", ((F.col("_a") + F.col("_b")) / 2).alias("score"))


def negative_pairs(positives: DataFrame, nodes: DataFrame, per_node: int, seed: int) -> DataFrame:
    """(a, b): per node, `per_node` partners that are no positives of it, or all there are.

    A seeded hash deals the nodes of a kind around a ring, and a node takes those that follow it.  A node with d positives in
    either direction looks `per_node` + d places ahead, at most once around: of these at most d are taken away, so it finds its
    number or has met every other.  `nodes` has node and, if pairs are to be of one kind, kind.

    Defined results: null nodes are left out, repeated nodes and positives are one; a kind with one node has no pairs.
    """
    kind = F.col("kind") if "kind" in nodes.columns else F.lit("")
    dealt = nodes.where("node IS NOT NULL").select(kind.alias("_kind"), F.struct(hash_order(F.col("node"), seed).alias("h"), "node").alias("_h")).distinct()
    ring = materialised(placed_values(dealt, "_kind", "_h").select("_kind", F.col("_h.node").alias("node"), F.col("before").alias("_r"), "total"))
    both = positives.select("a", "b").union(positives.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    taken = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    ahead = F.least(F.col("total") - 1, F.lit(per_node) + F.coalesce("_d", F.lit(0)))
    steps = ring.join(taken, "node", "left").withColumn("_far", ahead).where("_far > 0").withColumn("_step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_far"))))
    steps = steps.select("_kind", F.col("node").alias("a"), "_step", F.pmod(F.col("_r") + F.col("_step"), F.col("total")).alias("_r"))
    pairs = steps.join(ring.select("_kind", "_r", F.col("node").alias("b")), ["_kind", "_r"]).join(both, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("a", "_kind").orderBy("_step"))
    return pairs.withColumn("_n", nth).where(F.col("_n") <= per_node).select("a", "b")


def merge_tiny(sections: DataFrame, key: str, least: int = 64) -> DataFrame:
    """(key, idx, tokens, merged): sections below `least` tokens join the one before them, first to last.

    `sections` has idx and tokens; the first section of a document stays.
    """
    w = Window.partitionBy(key).orderBy("idx")
    head = F.when((F.col("tokens") >= least) | (F.row_number().over(w) == 1), F.col("idx"))
    owner = F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("_o", owner).groupBy(key, F.col("_o").alias("idx")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("merged"))


def selectivity(scores: DataFrame, least: int = 3) -> DataFrame:
    """(source, n, probe, gap): best score of a source less the mean of its others, with `least` or more."""
    g = scores.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("probe"), F.sum("score").alias("_s")).where(F.col("n") >= least)
    return g.select("source", "n", "probe", (F.col("probe") - (F.col("_s") - F.col("probe")) / (F.col("n") - 1)).alias("gap"))
