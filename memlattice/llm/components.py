"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are joins and partial aggregates on node ids; edges are written to
the shared folder after each round, so lineage stays short and a lost
executor costs one round; a round's table goes when the next one is written.
Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.shared import Scratch, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    `edges` has columns a and b (long); direction, repeats and loops don't matter.
    """
    spark = edges.sparkSession
    step = Scratch(spark)
    now = step.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(now)
    while state[0]:
        after = Scratch(spark)
        now = after.written(_small_star(_large_star(now)), "cc")
        step.clear()
        step, before, state = after, state, _state(now)
        if before == state:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = written(leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "nodes")
    step.clear()
    return out
