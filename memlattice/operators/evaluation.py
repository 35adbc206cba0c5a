"""Evaluation metrics as aggregations: AUC, confusion, recall, agreement, splits, regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.scoring import wilson
from memlattice.sources.sinks import materialised


def auc(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """(key, auc, positives, negatives): Mann-Whitney with average ranks for ties; null with one class.

    Ties are counted first, so ranks come from a window over distinct scores.
    """
    ties = rows.groupBy(key, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0)
    g = ranked.groupBy(key).agg(F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum("_p").alias("positives"), (F.sum("_n") - F.sum("_p")).alias("negatives"))
    u = F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2.0
    both = F.col("positives") * F.col("negatives")
    return g.select(key, F.when(both > 0, u / both).alias("auc"), "positives", "negatives")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)."""
    return rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def class_recall(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, n, recall, low, high) with Wilson bounds."""
    g = rows.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("recall"))
    low, high = wilson(F.col("recall"), F.col("n"))
    return g.withColumn("low", low).withColumn("high", high)


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(classes, macro_f1) over classes that occur in the truth."""
    hits = F.sum(F.when(F.col(truth) == F.col(guess), 1).otherwise(0))
    t = rows.groupBy(F.col(truth).alias("c")).agg(F.count(F.lit(1)).alias("t"), hits.alias("tp"))
    g = rows.groupBy(F.col(guess).alias("c")).agg(F.count(F.lit(1)).alias("g"))
    f1 = 2.0 * F.col("tp") / (F.col("t") + F.coalesce("g", F.lit(0)))
    return t.join(g, "c", "left").agg(F.count(F.lit(1)).alias("classes"), F.avg(f1).alias("macro_f1"))


def top_recall(ranked: DataFrame, query: str, rank: str, gold: str, k: int) -> DataFrame:
    """(query, recall, full): share of gold rows within the first k, and whether all are."""
    g = ranked.where(F.col(gold)).groupBy(query).agg(F.avg((F.col(rank) <= k).cast("double")).alias("recall"))
    return g.withColumn("full", F.col("recall") == 1.0)


def majority(votes: DataFrame, item: str, label: str, least: int = 2) -> DataFrame:
    """(item, label, votes): the label with most votes, ties to the first; null below `least`."""
    n = votes.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("votes"), label))
    return n.withColumn("_r", first).where("_r = 1").select(item, F.when(F.col("votes") >= least, F.col(label)).alias(label), "votes")


def hash_order(column: Column, seed: int) -> Column:
    """A seeded pseudo-random order of ids that any engine can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), column.cast("string")), 256)


def seeded_split(rows: DataFrame, column: str, fraction: float, seed: int) -> DataFrame:
    """Adds val: true for about `fraction` of the ids, the same on every run."""
    draw = F.conv(F.substring(hash_order(F.col(column), seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return rows.withColumn("val", draw < fraction)


def placed_values(rows: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, value, n, before, total): each distinct value, its rows, the rows of its key below it, and all of the key.

    With `weight` a row counts as that number of rows, which may be 0.

    Values are counted, dealt into ranges and summed per range, so a key's
    values never meet in one task.  Null values are left out; a key without any has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    dealt = materialised(counted.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_range")).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy("_key")  # one row per range
    sums = sums.select("_key", "_range", (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_base"), F.sum("_n").over(w).alias("total"))
    inside = Window.partitionBy(key, "_part").orderBy(value)
    placed = dealt.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")))
    return placed.select(key, value, "n", (F.col("_base") + F.sum("n").over(inside) - F.col("n")).alias("before"), "total")


def _value_at(value: str, index: Column) -> Column:
    """Aggregate of `placed_values`: the value at a 0-based place of its key's sorted rows."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col(value)))


def upper_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, least, upper_median, p99, most, mean): nearest-rank statistics of sorted values."""
    total = F.col("total")
    return placed_values(rows, key, value).groupBy(key).agg(
        F.max("total").alias("n"), F.min(value).alias("least"), _value_at(value, F.floor(total / 2)).alias("upper_median"),
        _value_at(value, F.least(total - 1, F.ceil(total * 0.99) - 1)).alias("p99"), F.max(value).alias("most"),
        (F.sum(F.col(value) * F.col("n")) / F.max("total")).alias("mean"),
    )


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column per name): values at shares of the sorted rows, interpolated between neighbours."""

    def between(share: float) -> Column:
        place = F.lit(share) * (F.col("total") - 1)
        low, high = _value_at(value, F.floor(place)), _value_at(value, F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed_values(rows, key, value).groupBy(key).agg(*[between(s).alias(name) for name, s in shares.items()])


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float) -> np.ndarray:
    """Weights of standardised features and an intercept, from sums gathered in one aggregate."""
    moments = rows.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features], F.avg(target), F.count(F.lit(1))).first()
    k = len(features)
    mean, std = np.array(moments[:k], float), np.array([s or 1.0 for s in moments[k : 2 * k]], float)
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, mean, std, strict=True)]
    y = F.col(target) - F.lit(float(moments[2 * k]))
    sums = rows.agg(*[F.sum(a * b) for a in z for b in z], *[F.sum(a * y) for a in z]).first()
    gram = np.array(sums[: k * k], float).reshape(k, k) + penalty * np.eye(k)
    return np.append(np.linalg.solve(gram, np.array(sums[k * k :], float)), float(moments[2 * k]))
