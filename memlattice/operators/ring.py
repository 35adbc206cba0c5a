"""The ring of a session's last touches as of any turn: an as-of join by slot numbers, contexts and traces from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.evaluation import placed_values
from memlattice.sources.sinks import materialised


def ring_at(touches: DataFrame, turns: DataFrame, ring: int) -> DataFrame:
    """(session, turn, slot, source, score): what the ring of the last `ring` touches held before each turn.

    `touches` has session, turn, pos, source, score; `turns` session and turn.  Slots are numbered through a session by
    counts of touches per turn, summed over ranges of turns, so a session is in no task whole.  A turn with f slots before
    it holds the slots f - ring to f - 1: both sides meet in bins of `ring` slots, of which a turn looks into two.

    Defined results: nulls in session, turn, pos or source are left out; of touches that repeat a place the one of the least source
    is taken; a turn that comes twice is one; a turn without slots before it has no rows.
    """
    clean = touches.where("session IS NOT NULL AND turn IS NOT NULL AND pos IS NOT NULL AND source IS NOT NULL")
    slots = materialised(clean.groupBy("session", "turn", "pos").agg(F.min(F.struct("source", "score")).alias("_t")).select("session", "turn", "pos", "_t.source", "_t.score"))
    asked = turns.where("session IS NOT NULL AND turn IS NOT NULL").select("session", "turn").distinct()
    weighed = slots.select("session", "turn", F.lit(1).alias("_w")).unionByName(asked.withColumn("_w", F.lit(0)))
    placed = materialised(placed_values(weighed, "session", "turn", "_w").select("session", "turn", "before"))
    nth = F.row_number().over(Window.partitionBy("session", "turn").orderBy("pos")) - 1
    numbered = slots.join(placed, ["session", "turn"]).withColumn("slot", F.col("before") + nth)
    held = numbered.select("session", F.floor(F.col("slot") / ring).alias("_bin"), "slot", "source", "score")
    bins = F.array_distinct(F.array(F.floor((F.col("before") - ring) / ring), F.floor((F.col("before") - 1) / ring)))
    looks = asked.join(placed, ["session", "turn"]).select("session", "turn", "before", F.explode(bins).alias("_bin"))
    met = looks.join(held, ["session", "_bin"]).where((F.col("slot") < F.col("before")) & (F.col("slot") >= F.col("before") - ring))
    return met.select("session", "turn", "slot", "source", "score")


def planned_context(ring_rows: DataFrame, retrieved: DataFrame, most: int) -> DataFrame:
    """(session, turn, unit, place, primary, strategy): retrieved units, those selected from the ring first.

    `retrieved` has session, turn, rank, unit.  Of the retrieved units that a slot of the turn's ring holds, the `most` of highest
    score are primary (ties: the newest slot); the others follow in order of rank.  The strategy is direct where
    all are primary, else chunked; a turn that selects nothing has none (null), and is left to another planner.
    A unit that is retrieved or held several times counts once, at its first rank and best slot.
    """
    once = retrieved.groupBy("session", "turn", F.col("unit")).agg(F.min("rank").alias("rank"))
    best = ring_rows.groupBy("session", "turn", F.col("source").alias("unit")).agg(F.max(F.struct("score", "slot")).alias("_s"))
    both = once.join(best, ["session", "turn", "unit"], "left")
    turn = Window.partitionBy("session", "turn")  # the results of one turn
    chosen = F.row_number().over(turn.orderBy(F.col("_s.score").desc_nulls_last(), F.col("_s.slot").desc_nulls_last(), "rank", "unit"))
    marked = both.withColumn("_c", F.when(F.col("_s").isNotNull(), chosen)).withColumn("primary", F.coalesce(F.col("_c") <= most, F.lit(False)))
    place = F.row_number().over(turn.orderBy(F.desc("primary"), F.when(F.col("primary"), F.col("_c")), "rank", "unit"))
    n, m = F.count(F.lit(1)).over(turn), F.sum(F.col("primary").cast("int")).over(turn)
    strategy = F.when(m == n, "direct").when(m > 0, "chunked")
    return marked.select("session", "turn", "unit", place.cast("long").alias("place"), "primary", strategy.alias("strategy"))


def trace_records(ring_rows: DataFrame, least: int = 3) -> DataFrame:
    """(session, turn, sources, scores, gold): a record per turn whose ring holds `least` slots with a score or more.

    Slots are in order, `gold` is the 0-based place of the highest score, the first of equal ones.  A record has a ring's slots at most.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("slot", "source", "score"))))
    whole = ring_rows.groupBy("session", "turn").agg(rows.alias("_r")).where(F.size("_r") >= least)
    scores = F.transform("_r", lambda x: x["score"])
    return whole.select("session", "turn", F.transform("_r", lambda x: x["source"]).alias("sources"), scores.alias("scores"), (F.array_position(scores, F.array_max(scores)) - 1).alias("gold"))
