"""Training losses as metrics over scored rows: cross-entropy, list-wise and ordered losses, contrast, ranking margin.

Sums of exponentials are kept stable without a first pass for the maximum: a score is split into a multiple of STEP and a
rest, the rests' exponentials are summed per multiple (which combines before a shuffle), and the few sums of a list are
put together from the highest multiple down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 100
#: Rows of an ordered list that are one block.
BLOCK = 1024


def list_lse(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, lse, n): log of the sum of exponentials of each list's scores, of any size; nulls are left out."""
    known = rows.where(F.col(key).isNotNull() & F.col(score).isNotNull())
    base = F.floor(F.col(score) / STEP)
    sums = known.groupBy(key, base.alias("_b")).agg(F.sum(F.exp(F.col(score) - base * STEP)).alias("_e"), F.count(F.lit(1)).alias("_n"))
    top = F.max("_b").over(Window.partitionBy(key))  # one row per multiple
    put = sums.withColumn("_top", top).groupBy(key).agg(F.max("_top").alias("_t"), F.sum(F.col("_e") * F.exp((F.col("_b") - F.col("_top")) * STEP)).alias("_s"), F.sum("_n").alias("n"))
    return put.select(key, (F.col("_t") * STEP + F.log("_s")).alias("lse"), "n")


def cross_entropy(logits: DataFrame, truth: DataFrame, weights: dict[int, float], unsafe: tuple[int, int] | None = None, penalty: float = 0.0) -> DataFrame:
    """(item, loss): weighted cross-entropy of `logits` (item, class, logit) against `truth` (item, class).

    With unsafe = (true, taken), an item of the first class also pays `penalty` times the probability of the second: the expected
    cost of that confusion.  A class without a weight has 1; items without a logit of their class are left out.
    """
    total = list_lse(logits, "item", "logit")
    own = logits.join(truth, ["item", "class"]).select("item", "class", "logit")
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]), F.col("class").cast("int")), F.lit(1.0)) if weights else F.lit(1.0)
    plain = own.join(total, "item").withColumn("loss", weight * (F.col("lse") - F.col("logit")))
    if unsafe:
        taken = logits.where(F.col("class") == unsafe[1]).select("item", F.col("logit").alias("_taken"))
        cost = F.when(F.col("class") == unsafe[0], penalty * F.exp(F.col("_taken") - F.col("lse")))
        plain = plain.join(taken, "item", "left").withColumn("loss", F.col("loss") + F.coalesce(cost, F.lit(0.0)))
    return plain.select("item", "loss")


def listwise(rows: DataFrame, key: str = "list") -> DataFrame:
    """(key, loss): mean over a list's gold rows of the negative log-softmax of their scores; 0 without gold.

    `rows` has key, score, gold.
    """
    gold = rows.groupBy(key).agg(F.sum(F.when(F.col("gold") & F.col("score").isNotNull(), F.col("score"))).alias("_s"), F.count(F.when(F.col("gold") & F.col("score").isNotNull(), 1)).alias("_g"))
    loss = F.when(F.col("_g") > 0, F.col("lse") - F.col("_s") / F.col("_g")).otherwise(0.0)
    return gold.join(list_lse(rows, key, "score"), key).select(key, loss.alias("loss"))


def _plus(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); a null counts as nothing."""
    both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def plackett_luce(rows: DataFrame, key: str = "list") -> DataFrame:
    """(key, n, loss): negative log-likelihood of each list's order under its scores.

    `rows` has key, place (0, 1, ... without gaps) and score.  A place costs the log-sum-exp of its own and all later scores less
    its own.  A list is cut into blocks of BLOCK places: each block's log-sum-exp, then what follows each
    block (one number a block), then the places inside.  Repeated places are taken once, the greatest score.
    """
    clean = rows.where(F.col(key).isNotNull() & F.col("place").isNotNull() & F.col("score").isNotNull()).groupBy(key, "place").agg(F.max("score").cast("double").alias("score"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("place", "score"))))
    blocks = clean.groupBy(key, F.floor(F.col("place") / BLOCK).alias("_k")).agg(ordered.alias("_r"))
    nothing = F.lit(None).cast("double")
    own = F.aggregate("_r", nothing, lambda acc, x: _plus(acc, x["score"]))
    tails = blocks.select(key, "_k", own.alias("_l")).groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_k", "_l")))).alias("_b"))
    begin = F.struct(nothing.alias("tail"), F.array().cast("array<struct<k:bigint,tail:double>>").alias("out"))
    step = lambda acc, x: F.struct(_plus(acc["tail"], x["_l"]).alias("tail"), F.concat(acc["out"], F.array(F.struct(x["_k"].alias("k"), acc["tail"].alias("tail")))).alias("out"))
    after = tails.select(key, F.inline(F.aggregate("_b", begin, step, lambda acc: acc["out"]))).withColumnRenamed("k", "_k")
    start = F.struct(F.col("tail"), F.lit(0.0).alias("loss"))
    fold = lambda acc, x: F.struct(_plus(acc["tail"], x["score"]).alias("tail"), (acc["loss"] + _plus(acc["tail"], x["score"]) - x["score"]).alias("loss"))
    inside = blocks.join(after, [key, "_k"]).select(key, F.size("_r").alias("_n"), F.aggregate("_r", start, fold, lambda acc: acc["loss"]).alias("_c"))
    return inside.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_c").alias("loss"))


def in_batch_contrast(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(batch, n, loss): mean over a batch of how an anchor's own partner stands against all partners of the batch.

    `pairs` has batch, anchor and positive (vectors of one length); likeness is the cosine over the temperature, a zero vector is like nothing.  A
    batch is one task's matrix, as large as the caller makes its batches; rows with a null are left out.
    """

    def unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
        x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def loss(table: pa.Table) -> pa.Table:
        like = unit(table["anchor"], table.num_rows) @ unit(table["positive"], table.num_rows).T / temperature
        top = like.max(axis=1)
        lse = top + np.log(np.exp(like - top[:, None]).sum(axis=1))
        return pa.table({"batch": table["batch"].slice(0, 1), "n": pa.array([table.num_rows], pa.int64()), "loss": pa.array([float((lse - np.diag(like)).mean())])})

    known = pairs.where("batch IS NOT NULL AND anchor IS NOT NULL AND positive IS NOT NULL").select(F.col("batch").cast("long").alias("batch"), "anchor", "positive")
    return known.groupBy("batch").applyInArrow(loss, "batch long, n long, loss double")


def margin_ranking(pairs: DataFrame, margin: float) -> DataFrame:
    """(n, broken, loss): pairs (better, worse) of scores, how many are closer than the margin, and the mean shortfall."""
    short = F.greatest(F.lit(0.0), F.lit(margin) - (F.col("better") - F.col("worse")))
    known = pairs.where("better IS NOT NULL AND worse IS NOT NULL")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(short > 0, 1)).alias("broken"), F.avg(short).alias("loss"))
