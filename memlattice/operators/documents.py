"""Documents: aggregation of hits, ontology closure, anomaly rules, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised


def document_results(hits: DataFrame, most: int = 5) -> DataFrame:
    """Section hits (query_id, doc, section, score, entities) as one row per document.

    Score is the best section's, entities are united, and the `most` best sections are listed.
    """
    order = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "section"))
    ranked = hits.withColumn("_r", order)
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "section")))), lambda x: x["section"])
    return ranked.groupBy("query_id", "doc").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("n_sections"), top.alias("sections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"),
    )


def class_closure(classes: DataFrame) -> DataFrame:
    """(child, ancestor, distance) of a subclass table (child, parent), least distances; cycles end, depth has no bound."""
    level = materialised(classes.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    out, d = level, 1
    while not level.isEmpty():
        d += 1
        step = level.join(classes.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        level = materialised(step.join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("distance", F.lit(d)))
        out = out.unionByName(level)
    return out


def greedy_chunks(parts: DataFrame, key: str, budget: int = 512) -> DataFrame:
    """(key, idx, chunk): consecutive parts packed until the next would overflow; one over budget is alone.

    `parts` has idx and tokens.
    """
    ordered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("tokens").cast("long").alias("tokens")))).alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<idx:bigint,chunk:bigint>>").alias("out"))

    def step(acc, p):
        over = (acc["used"] + p["tokens"] > budget) & (acc["used"] > 0)
        chunk = F.when(over, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(over, p["tokens"]).otherwise(acc["used"] + p["tokens"])
        row = F.array(F.struct(p["idx"].cast("long").alias("idx"), chunk.alias("chunk")))
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(acc["out"], row).alias("out"))

    return ordered.select(key, F.inline(F.aggregate("_p", start, step)["out"]))


def shards(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds shard: fixed-size chunks of ids in order, numbered within partitions of the id range."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1
    return rows.withColumn("shard", F.floor(nth / size))


def nonadjacent_pairs(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(center, a, b): per subgraph, pairs of one kind without an edge, the first `most` in order.

    `nodes` has center, node, kind; a cap on candidates is the operator's own parameter.  A node
    with d edges meets the `most` + d nodes after it: at least `most` of them are free, or all were met.
    """
    both = edges.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    taken = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    nth = F.row_number().over(Window.partitionBy("center", "kind").orderBy("node"))
    ranked = nodes.distinct().withColumn("_r", nth)
    last = F.col("_r") + most + F.coalesce("_d", F.lit(0)).cast("int")
    steps = ranked.join(taken, "node", "left").withColumn("_to", F.explode(F.sequence(F.col("_r") + 1, last)))
    after = ranked.select("center", "kind", F.col("_r").alias("_to"), F.col("node").alias("b"))
    pairs = steps.join(after, ["center", "kind", "_to"]).select("center", F.col("node").alias("a"), "b")
    free = pairs.join(both, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("center").orderBy("a", "b"))
    return free.withColumn("_n", nth).where(F.col("_n") <= most).select("center", "a", "b")
