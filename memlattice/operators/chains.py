"""Chains of links by pointer doubling: places of all nodes in as many rounds as the longest chain's length has bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised


def single_links(links: DataFrame) -> DataFrame:
    """(node, next) where each node has one next and each next one node: the least next, then the least node that claims it."""
    real = links.where("node IS NOT NULL AND next IS NOT NULL AND node <> next")
    forward = real.groupBy("node").agg(F.min("next").alias("next"))
    return forward.groupBy("next").agg(F.min("node").alias("node")).select("node", "next")


def _doubled(before: DataFrame) -> DataFrame:
    """(node, at, steps, done, least) of nodes with the node before them, null at a head.

    Every round each unfinished node takes over its pointer's pointer, so its reach doubles; `at` is the head where done.
    A round in which nothing is finished and no least member of a reach changes ends it: what is left are cycles.
    """
    state = materialised(
        before.select(
            "node", F.coalesce("before", "node").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"),
            F.col("before").isNull().alias("done"), F.least("node", F.coalesce("before", "node")).alias("least"),
        )
    )
    while True:
        there = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        moved = state.where("NOT done").join(there, "at").select(
            "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"), F.least("least", "_least").alias("least"),
            (F.col("_done") | (F.col("_least") < F.col("least"))).alias("_changed"),
        )
        moved = materialised(moved)
        changed = moved.agg(F.max("_changed").alias("c")).first().c
        state = materialised(state.where("done").unionByName(moved.drop("_changed")))
        if not changed:
            return state


def ranked_chains(links: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, chain, position, length, cyclic) of every node of `links` (node, next).

    A chain is named by its head and counted from 0; a cycle is cut before its least member, which is
    its head.  With `limit` only the first `limit` nodes of a chain are returned, and length is at most that.

    Defined results: where a node has several next ones, or several nodes one next, `single_links` decides, and a node that
    loses its claim begins or ends a chain there; nulls and links to itself are left out (a node that is in no other link
    is no row); repeated links are one; an empty table gives no rows.
    """
    used = materialised(single_links(links))
    nodes = links.where("node IS NOT NULL AND next IS NOT NULL AND node <> next").select(F.explode(F.array("node", "next")).alias("node")).distinct()
    before = used.select(F.col("next").alias("node"), F.col("node").alias("before"))
    state = _doubled(nodes.join(before, "node", "left"))
    rounds = state.where("NOT done").select("node", F.col("least").alias("chain"))
    placed = state.where("done").select("node", F.col("at").alias("chain"), F.col("steps").alias("position"), F.lit(False).alias("cyclic"))
    if not rounds.isEmpty():
        cut = rounds.join(before, "node").select("node", F.when(F.col("node") != F.col("chain"), F.col("before")).alias("before"))
        again = _doubled(cut)
        placed = placed.unionByName(again.select("node", F.col("at").alias("chain"), F.col("steps").alias("position"), F.lit(True).alias("cyclic")))
    if limit is not None:
        placed = placed.where(F.col("position") < limit)
    length = placed.groupBy("chain").agg(F.count(F.lit(1)).alias("length"))
    return placed.join(length, "chain").select("node", "chain", "position", "length", "cyclic")


def walked_chains(links: DataFrame, limit: int = 64, least: int = 2) -> DataFrame:
    """(start, position, node, length): the walk from every node that nothing leads to, `limit` nodes at most.

    A walk goes to the least next node and ends before a node that it has met; walks that meet share what follows.  Known
    positions double with every round: those below 2^k, each moved on by 2^k steps, are the next 2^k.  Walks of fewer than `least`
    nodes are left out.
    """
    real = links.where("node IS NOT NULL AND next IS NOT NULL AND node <> next")
    jump = materialised(real.groupBy("node").agg(F.min("next").alias("next")))
    starts = real.select("node").distinct().join(real.select(F.col("next").alias("node")).distinct(), "node", "left_anti")
    known = materialised(starts.select(F.col("node").alias("start"), F.lit(0).cast("long").alias("position"), "node"))
    reach = 1
    while reach < limit:
        ahead = known.join(jump, "node").select("start", (F.col("position") + reach).alias("position"), F.col("next").alias("node"))
        known = materialised(known.unionByName(ahead))
        on = jump.select(F.col("node").alias("next"), F.col("next").alias("_on"))
        jump = materialised(jump.join(on, "next").select("node", F.col("_on").alias("next")))
        reach *= 2
    first = known.where(F.col("position") < limit).groupBy("start", "node").agg(F.min("position").alias("position"))  # a cycle's members come again
    length = first.groupBy("start").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)
    return first.join(length, "start").select("start", "position", "node", "length")


def chain_sequences(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(chain, sequence): states of chains put together from forward pairs (chain, position, type, state, next_state).

    A chain is there only if its positions run from 0 without a gap; of pairs that repeat a position the least is taken.  One chain's
    sequence is one row, so chains should be bounded before (`walked_chains`, or a limit of `ranked_chains`).
    """
    one = pairs.where("type = 'forward' AND chain IS NOT NULL AND position IS NOT NULL").groupBy("chain", "position").agg(F.min(F.struct("state", "next_state")).alias("_p"))
    rows = F.array_sort(F.collect_list(F.struct("position", "_p.state", "_p.next_state")))
    whole = one.groupBy("chain").agg(F.min("position").alias("_low"), F.max("position").alias("_high"), F.count(F.lit(1)).alias("_n"), rows.alias("_r"))
    whole = whole.where((F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1) & (F.col("_n") + 1 >= least))
    return whole.select("chain", F.concat(F.array(F.col("_r")[0]["state"]), F.transform("_r", lambda x: x["next_state"])).alias("sequence"))
