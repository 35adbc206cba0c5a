"""Evaluation of gates: threshold sweeps, selectivity of facts, probe schedules, routing, metrics of heads.

Defined results are stated at each function; empty tables give empty tables, or one row of counts of 0 and nulls where a table
is summed up as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.operators.evaluation import auc, hash_order, placed_values


def threshold_sweep(trials: DataFrame, grids: dict[str, list[float]], shipped: dict[str, float]) -> DataFrame:
    """(axis, value, firing, coverage_on, coverage_off, delta, rescued): one threshold varied, the others as shipped.

    Trials have relevance, recoverability, surprise and covered (without firing).  A trial fires with recoverability under theta,
    relevance over phi and surprise under cap; one with a null among them never does.  Axes are theta, phi and cap.

    Trials are counted once by the place in each grid from which on they fire; the sweep reads those few counts.
    """
    passes = {
        "theta": lambda v: F.col("recoverability") < v,
        "phi": lambda v: F.col("relevance") > v,
        "cap": lambda v: F.col("surprise") < v,
    }

    def fires(axis: str) -> Column:
        """The values of an axis' grid at which a trial fires."""
        others = reduce(lambda a, b: a & b, [test(F.lit(shipped[a])) for a, test in passes.items() if a != axis])
        grid = F.array(*[F.lit(float(v)) for v in grids[axis]])
        return F.when(F.coalesce(others, F.lit(False)), F.filter(grid, lambda v: F.coalesce(passes[axis](v), F.lit(False)))).otherwise(F.array().cast("array<double>"))

    covered = F.coalesce("covered", F.lit(False)).alias("covered")
    counted = [trials.groupBy(F.lit(a).alias("axis"), fires(a).alias("_at"), covered).agg(F.count(F.lit(1)).alias("_n")) for a in grids]
    value = F.explode(F.element_at(F.create_map(*[x for a, g in grids.items() for x in (F.lit(a), F.array(*[F.lit(float(v)) for v in g]))]), F.col("axis")))
    steps = reduce(DataFrame.unionByName, counted).withColumn("value", value).withColumn("_f", F.array_contains("_at", F.col("value")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    f, c = F.col("_f"), F.col("covered")
    swept = steps.groupBy("axis", "value").agg(total(f).alias("firing"), total(f | c).alias("coverage_on"), total(c).alias("coverage_off"), total(f & ~c).alias("rescued"))
    return swept.withColumn("delta", F.col("coverage_on") - F.col("coverage_off"))


def selectivity(scores: DataFrame) -> DataFrame:
    """(fact, probe, filler, n_filler, gap) of scores (turn, fact, target, relevance).

    The probe is the relevance at the last turn that asks for the fact, the filler's the mean over turns that ask for none; the gap
    is null where either is missing.  Rows without fact or relevance are left out.
    """
    known = scores.where("fact IS NOT NULL AND relevance IS NOT NULL")
    asked, idle = F.col("target") == F.col("fact"), F.col("target").isNull()
    g = known.groupBy("fact").agg(
        F.max(F.when(asked, F.struct("turn", "relevance"))).alias("_p"), F.avg(F.when(idle, F.col("relevance"))).alias("filler"), F.count_if(idle).alias("n_filler"),
    )
    return g.select("fact", F.col("_p.relevance").alias("probe"), "filler", "n_filler", (F.col("_p.relevance") - F.col("filler")).alias("gap"))


def discriminates(facts: DataFrame, margin: float = 0.2) -> DataFrame:
    """(discriminates, min_gap, n): whether every gap of `selectivity` reaches the margin; no gap at all is no."""
    return facts.agg(F.coalesce(F.min("gap") >= margin, F.lit(False)).alias("discriminates"), F.min("gap").alias("min_gap"), F.count("gap").alias("n"))


def probe_schedule(facts: DataFrame, fillers: list[str], horizon: int, seed: int) -> DataFrame:
    """(center, turn, fact, filler): for each center the turns 0 to horizon - 1, each a probe of one fact or a filler.

    Facts (center, fact) are put in a seeded order.  The first probe comes at a quarter of the horizon (8 at least), the next ones at
    even steps (4 at least); those beyond the end fall on the last turn, where the last in order stays.  Fillers follow in a
    seeded order, turn by turn.
    """
    known = facts.where("center IS NOT NULL AND fact IS NOT NULL").select("center", "fact").distinct()
    drawn = known.select("center", F.concat(hash_order(F.col("fact"), seed), "fact").alias("_d"))
    placed = placed_values(drawn, "center", "_d")
    start = max(8, horizon // 4)
    step = F.greatest(F.lit(4), F.floor(F.lit(horizon - start - 2) / F.greatest(F.lit(1), F.col("total") - 1)))
    turn = F.least(F.lit(start) + F.col("before") * F.when(F.col("total") > 1, step).otherwise(1), F.lit(horizon - 1)).cast("long")
    fact = F.substring("_d", F.lit(65), F.length("_d"))
    probes = placed.groupBy("center", turn.alias("turn")).agg(F.max_by(fact, "before").alias("fact"))
    turns = known.select("center").distinct().select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(horizon - 1).cast("long"))).alias("turn"))
    shuffled = F.transform(F.array_sort(F.array(*[F.struct(hash_order(F.lit(x), seed).alias("h"), F.lit(x).alias("x")) for x in fillers])), lambda r: r["x"])
    filler = F.when(F.col("fact").isNull(), F.get(shuffled, F.col("turn") % len(fillers)))
    return turns.join(probes, ["center", "turn"], "left").select("center", "turn", "fact", filler.alias("filler"))


def set_f1(want: Column, got: Column) -> Column:
    """F1 of two arrays of distinct elements: 1 where both are empty, 0 where one is."""
    a, b = F.size(want), F.size(got)
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(want, got)) / (a + b))


def routing_accuracy(routes: DataFrame, domains: Column | None = None) -> DataFrame:
    """(accuracy, pathway, domain, size, deliberation, n): the weighted score of routes and its parts, null without rows.

    `routes` has structs `want` and `got` with pathway, domains, size and deliberates.  Wanted domains outside the array `domains` of available ones
    do not count.  Missing arrays are empty, a missing wish to deliberate is no.
    """
    want, got = F.col("want"), F.col("got")
    empty = F.array().cast("array<string>")
    listed = F.array_distinct(F.coalesce(want["domains"], empty))
    listed = listed if domains is None else F.array_intersect(listed, domains)
    same = lambda name: F.avg(want[name].eqNullSafe(got[name]).cast("double"))
    calm = F.coalesce(want["deliberates"], F.lit(False)) == F.coalesce(got["deliberates"], F.lit(False))
    parts = routes.agg(
        same("pathway").alias("pathway"), F.avg(set_f1(listed, F.array_distinct(F.coalesce(got["domains"], empty)))).alias("domain"),
        same("size").alias("size"), F.avg(calm.cast("double")).alias("deliberation"), F.count(F.lit(1)).alias("n"),
    )
    return parts.withColumn("accuracy", 0.35 * F.col("pathway") + 0.30 * F.col("domain") + 0.20 * F.col("size") + 0.15 * F.col("deliberation"))


def head_metrics(rows: DataFrame) -> DataFrame:
    """(head, n, mae, accuracy, quality) of scores (head, score, label 0 or 1): quality is the area under the curve, or accuracy where a head saw one class.

    A score is rounded half to even for the accuracy.  Rows with a null are left out.
    """
    known = rows.where("head IS NOT NULL AND score IS NOT NULL AND label IS NOT NULL")
    g = known.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("score") - F.col("label"))).alias("mae"), F.avg((F.bround("score") == F.col("label")).cast("double")).alias("accuracy"))
    return g.join(auc(known, "head", "score", "label").select("head", "auc"), "head").select("head", "n", "mae", "accuracy", F.coalesce("auc", "accuracy").alias("quality"))
