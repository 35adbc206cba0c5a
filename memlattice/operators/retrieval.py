"""Ranked retrieval for a whole table of query plans at once."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.evaluation import placed_values
from memlattice.operators.flagged import first_of_each
from memlattice.operators.graph import axis_candidates
from memlattice.operators.units import visible_candidates
from memlattice.sources.sinks import materialised

#: Fixed weights of a match on each axis and of recency.
ENTITY, TOPIC, TONE, RECENCY = 10.0, 5.0, 3.0, 0.1


def plan_axes(plans: DataFrame) -> DataFrame:
    """(query_id, predicate, object, need) of plans with entities, topics, tones and entity_mode."""

    both = F.when(F.col("entity_mode") == "intersection", F.size("entities")).otherwise(1)

    def axis(column: str, predicate: str, prefix: str, need: Column) -> Column:
        return F.transform(F.coalesce(column, F.array()), lambda v: F.struct(F.lit(predicate).alias("predicate"), F.concat(F.lit(prefix), v).alias("object"), need.alias("need")))

    every = F.concat(axis("entities", "has_entity", "E:", both), axis("topics", "has_topic", "T:", F.lit(1)), axis("tones", "has_tone", "A:", F.lit(1)))
    return plans.select("query_id", F.explode(every).alias("_a")).select("query_id", "_a.predicate", "_a.object", "_a.need")


def retrieve(plans: DataFrame, episodes: DataFrame, edges: DataFrame, salience: DataFrame, boost: DataFrame | None = None, limit: int = 5, states: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): matched weights plus recency, times the unit's boost, best first.

    `salience` has entity and value (0 where missing); `boost` unit and value (1
    where missing); `states` id, state and validity_end: units that it says are no longer in force are no candidates.  Units are
    whatever `edges` begin in and `episodes` (id, ts) knows a time of: episodes, sections, documents.  Equal scores go by id.

    Axes and candidates are written once and read by all that follows.  A plan's candidates are placed in time by ranges and
    cut to their best in salted parts, so no task holds all candidates of a plan.
    """
    axes = materialised(plan_axes(plans))
    found = axis_candidates(axes, edges)
    candidates = materialised(visible_candidates(found, states) if states is not None else found)
    timed = candidates.join(episodes.select("id", "ts"), "id").withColumn("_at", F.struct("ts", "id"))
    placed = placed_values(timed, "query_id", "_at").select("query_id", F.col("_at.id").alias("id"), F.col("before").alias("_recency"))
    hits = candidates.join(edges, F.col("id") == F.col("s")).join(
        axes.select("query_id", F.col("predicate").alias("p"), F.col("object").alias("o")).distinct(), ["query_id", "p", "o"], "left_semi"
    )
    weight = (
        F.when(F.col("p") == "has_entity", F.lit(ENTITY) * (F.lit(0.5) + F.lit(0.5) * F.coalesce("value", F.lit(0.0))))
        .when(F.col("p") == "has_topic", F.lit(TOPIC))
        .otherwise(F.lit(TONE))
    )
    matched = hits.join(salience.select(F.col("entity").alias("o"), "value"), "o", "left").groupBy("query_id", "id").agg(F.sum(weight).alias("matched"))
    scored = placed.join(matched, ["query_id", "id"], "left")
    score = F.coalesce("matched", F.lit(0.0)) + F.lit(RECENCY) * F.col("_recency")
    if boost is not None:
        scored = scored.join(boost.select(F.col("unit").alias("id"), F.col("value").alias("_boost")), "id", "left")
        score = score * F.coalesce("_boost", F.lit(1.0))
    scored = scored.withColumn("score", score).withColumn("_best", F.struct(-F.round("score", 9), "id"))
    best = Window.partitionBy("query_id").orderBy("_best")
    return first_of_each(scored, "query_id", "_best", limit).withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "id", "score")


def diverse(results: DataFrame, most: int = 3) -> DataFrame:
    """Greedy order by score with at most `most` of one kind in a row, per query.

    A kind that has reached the limit waits for the next row of another kind; when only
    one kind is left its rows follow in order.
    """

    def rerank(group):  # one query's results, a short list
        ordered = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        waiting: dict[str, deque[int]] = {}  # places of each kind, best first
        for place, kind in enumerate(ordered["kind"]):
            waiting.setdefault(kind, deque()).append(place)
        out, run, last = [], 0, None
        while waiting:
            free = [k for k in waiting if run < most or k != last] or list(waiting)
            kind = min(free, key=lambda k: waiting[k][0])
            out.append(waiting[kind].popleft())
            run, last = (run + 1 if kind == last else 1), kind
            if not waiting[kind]:
                del waiting[kind]
        return ordered.loc[out].assign(position=range(len(out)))

    schema = "query_id string, id string, kind string, score double, position int"
    return results.select("query_id", "id", "kind", "score").groupBy("query_id").applyInPandas(rerank, schema)


def packed_prefix(rows: DataFrame, partition: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each partition, in order, up to the first that overflows the budget."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def packed_skip(rows: DataFrame, partition: str, cost: str, budget: int, most: int) -> DataFrame:
    """(partition, chosen): a greedy pass that skips what does not fit, `most` rows at most.

    `rows` has columns partition, position, id and the cost.
    """
    ordered = rows.groupBy(partition).agg(F.array_sort(F.collect_list(F.struct("position", "id", F.col(cost).cast("long").alias("cost")))).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    step = lambda acc, r: F.when(
        (acc["used"] + r["cost"] <= budget) & (F.size(acc["ids"]) < most),
        F.struct((acc["used"] + r["cost"]).alias("used"), F.concat(acc["ids"], F.array(r["id"])).alias("ids")),
    ).otherwise(acc)
    return ordered.select(partition, F.aggregate("_rows", start, step).alias("_out")).select(partition, F.col("_out.ids").alias("ids"), F.col("_out.used").alias("used"))
