"""Forgetting, supersession, archiving and compounding state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import scoring as S
from memlattice.operators.evaluation import placed_values
from memlattice.sources.sinks import materialised


def latest_assertion(assertions: DataFrame) -> DataFrame:
    """One row per (entity, value): the newest assertion's provenance."""
    newest = F.max_by(F.struct("asserted_by", "asserted_at"), F.struct("asserted_at", "asserted_by"))
    return assertions.groupBy("entity", "value").agg(newest.alias("_a")).select("entity", "value", "_a.asserted_by", "_a.asserted_at")


def validity_intervals(assertions: DataFrame) -> DataFrame:
    """Each assertion with the time the next different one of its entity closes it (null while current)."""
    w = Window.partitionBy("entity").orderBy("asserted_at", "asserted_by")
    changed = assertions.withColumn("_before", F.lag("value").over(w)).where("_before IS NULL OR _before <> value").drop("_before")
    return changed.withColumn("valid_until", F.lead("asserted_at").over(w)).withColumn("superseded_by", F.lead("asserted_by").over(w))


def contradictions(assertions: DataFrame) -> DataFrame:
    """Entities with more than one value, and the oldest and newest assertion."""
    order = F.struct("asserted_at", "asserted_by")
    return assertions.groupBy("entity").agg(
        F.countDistinct("value").alias("n_values"), F.array_sort(F.collect_set("value")).alias("values"),
        F.min_by("asserted_by", order).alias("oldest"), F.max_by("asserted_by", order).alias("newest"),
    ).where("n_values > 1")


def folded(steps: DataFrame, start: float, run: int = 4096) -> DataFrame:
    """(unit, value, n): a value changed step by step in the order of `position`, from `start`.

    Each step (unit, position, factor, low, high) takes a value x to x times a factor above 0, held between low and high.  Several such steps
    in a row are a step of the same kind.  So ranges of positions are folded on their own, in runs of `run` steps, and a unit's folded
    runs are applied in order.
    """
    held = lambda x, m: F.least(m["high"], F.greatest(m["low"], x * m["factor"]))
    dealt = materialised(steps.select("unit", "position", "factor", "low", "high").repartitionByRange("unit", "position").withColumn("_part", F.spark_partition_id()))
    nth = F.row_number().over(Window.partitionBy("unit", "_part").orderBy("position")) - 1
    runs = dealt.withColumn("_run", F.floor(nth / run)).groupBy("unit", "_part", "_run")
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("position", "factor", "low", "high"))).alias("_r"))
    same = F.struct(F.lit(1.0).alias("factor"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    more = lambda m, r: F.struct((m["factor"] * r["factor"]).alias("factor"), held(m["low"], r).alias("low"), held(m["high"], r).alias("high"))
    maps = listed.select("unit", "_part", "_run", F.size("_r").cast("long").alias("_n"), F.aggregate("_r", same, more).alias("_m"))
    ordered = maps.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("_part", "_run", "_m"))).alias("_m"), F.sum("_n").alias("n"))
    return ordered.select("unit", F.aggregate("_m", F.lit(start), lambda x, m: held(x, m["_m"])).alias("value"), "n")


def compounded_boost(ratings: DataFrame, run: int = 4096) -> DataFrame:
    """(unit, value, n): ratings from 1 to 5 applied in order, clamped at every step.

    `ratings` has unit, position and rating.
    """
    low, high = (F.lit(float(x)) for x in S.UNIT_BOOST)
    kept = ratings.where("rating BETWEEN 1 AND 5 AND NOT unit RLIKE '[/\\\\x00]'")
    factor = F.lit(0.5) + (F.col("rating").cast("double") - 1) / F.lit(4.0)
    return folded(kept.select("unit", "position", factor.alias("factor"), low.alias("low"), high.alias("high")), 1.0, run)


def counted_before(retrievals: DataFrame, seconds: int = 86400) -> DataFrame:
    """Adds `earlier`, an edge's retrievals at earlier times, `at_once`, those at the same time, and `recent`, those of the last `seconds` with the time itself.

    `retrievals` has edge and seconds.  Times are counted and numbered by ranges; what is recent is counted
    in windows of two spans of an edge at most.
    """
    placed = placed_values(retrievals, "edge", "seconds").select("edge", "seconds", F.col("n").alias("at_once"), F.col("before").alias("earlier"))
    span = F.floor(F.col("seconds") / seconds)
    spans = placed.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_span", F.when(F.col("_own"), span).otherwise(span + 1))
    w = Window.partitionBy("edge", "_span").orderBy("seconds").rangeBetween(1 - seconds, 0)
    counts = spans.withColumn("recent", F.sum("at_once").over(w)).where("_own").drop("_own", "_span")
    return retrievals.join(counts, ["edge", "seconds"])


def retrieval_fold(retrievals: DataFrame, start_rate: float = 0.01, run: int = 4096) -> DataFrame:
    """(edge, rate, n): decay rate after all retrievals of an edge in time order.

    `retrievals` has edge, seconds, modifier and event_id, which puts those of one second in order.  Each step knows the number of earlier
    retrievals and those of the day before it.  Over the daily limit the rate rises to its ceiling, else it
    falls to its floor: steps that fold.  Rows without edge or time are left out.
    """
    known = counted_before(retrievals.where("edge IS NOT NULL AND seconds IS NOT NULL"))
    # only what an edge has in one second meets in a window
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy("edge", "seconds").orderBy("event_id")) - 1
    worn = F.col("recent") > S.SATURATION_PER_DAY
    steps = known.withColumn("_n", nth).select(
        F.col("edge").alias("unit"), F.col("_n").alias("position"), F.when(worn, F.lit(S.WORN)).otherwise(S.eased(F.col("_n"), F.col("modifier"))).alias("factor"),
        F.lit(S.MIN_DECAY_RATE).alias("low"), F.when(worn, F.lit(S.MAX_DECAY_RATE)).otherwise(F.lit(float("inf"))).alias("high"),
    )
    return folded(steps, start_rate, run).select(F.col("unit").alias("edge"), F.col("value").alias("rate"), "n")


def dream(edges: DataFrame, now_days: Column) -> DataFrame:
    """Adds decayed rate and score, utility and the archive decision to edges.

    Columns used: score, rate, base_rate, last (double days), access (`access_frequency`), structural.
    """
    idle = F.greatest(F.lit(0.0), now_days - F.col("last"))
    out = edges.withColumn("new_rate", S.dream_rate(F.col("rate"), F.col("base_rate"), idle))
    out = out.withColumn("new_score", S.dream_score(F.col("score"), F.col("new_rate"), idle))
    value = S.utility(F.col("access"), F.col("structural"))
    return out.withColumn("utility", value).withColumn("archive", F.col("utility") < S.PRUNE_BELOW)


def refcounts(sections: DataFrame) -> DataFrame:
    """(blob_hash, refs): derived, never stored."""
    return sections.groupBy("blob_hash").agg(F.count(F.lit(1)).alias("refs"))


def refcount_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(blob_hash, delta) between two section tables, unchanged blobs left out."""
    a = refcounts(old).withColumnRenamed("refs", "_old")
    b = refcounts(new).withColumnRenamed("refs", "_new")
    delta = (F.coalesce("_new", F.lit(0)) - F.coalesce("_old", F.lit(0))).alias("delta")
    return a.join(b, "blob_hash", "full").select("blob_hash", delta).where("delta <> 0")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and rows of `old` whose key is not in `new`."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side; empty after a faithful rewrite."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))
