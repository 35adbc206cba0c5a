"""Outlines: parents by levels, and tiny sections contracted into their parents from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.graph import union_all
from memlattice.sources.sinks import materialised


def levels_of(sections: DataFrame) -> list[int]:
    """The distinct levels, ascending; as many as the deepest outline has."""
    return sorted(r.level for r in sections.where("level IS NOT NULL").select("level").distinct().collect())


def with_parents(sections: DataFrame, key: str, levels: list[int]) -> DataFrame:
    """Adds parent: the idx of the nearest earlier section of a lower level, null at the top."""
    earlier = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    parent: Column = F.lit(None).cast("long")
    for level in levels[1:]:
        above = F.max(F.when(F.col("level") < level, F.col("idx"))).over(earlier)
        parent = F.when(F.col("level") == level, above).otherwise(parent)
    return sections.withColumn("parent", parent)


def tokens_of(chars: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.floor(chars / 4), F.lit(1)).cast("long")


def contracted(sections: DataFrame, key: str, least: int = 64) -> DataFrame:
    """(key, idx, level, parent, tokens, merged, content): sections with all tiny ones moved into their parents.

    `sections` has idx (its place in the document), level and content.  From the deepest level
    up, a section below `least` tokens, with what it has taken in before, is appended to its
    parent after a blank line, in order of places; a section without a parent stays.  Parents of what is left are
    the nearest earlier sections of a lower level.  All documents go one level at a
    time, and only sizes take part in that; each text moves once, at the end.

    Defined results: a null content counts as empty; an empty content adds neither text nor blank line but
    counts as one token; rows without document, place or level are left out; of rows that repeat a place one
    is taken, the least content; an empty table gives none.
    """
    known = sections.select(key, F.col("idx").cast("long").alias("idx"), F.col("level").cast("int").alias("level"), F.coalesce("content", F.lit("")).alias("content"))
    known = known.where(F.col(key).isNotNull() & F.col("idx").isNotNull() & F.col("level").isNotNull()).groupBy(key, "idx").agg(F.min(F.struct("content", "level")).alias("_s"))
    texts = materialised(known.select(key, "idx", "_s.level", "_s.content"))
    levels = levels_of(texts)
    sized = texts.select(key, "idx", "level", F.length("content").cast("long").alias("chars"))
    state = materialised(with_parents(sized, key, levels).withColumn("gone", F.lit(False)))
    for level in reversed(levels[1:]):
        falls = (F.col("level") == level) & (tokens_of(F.col("chars")) < least) & F.col("parent").isNotNull()
        taken = state.where(falls & (F.col("chars") > 0)).groupBy(key, F.col("parent").alias("idx")).agg(F.sum("chars").alias("_more"), F.count(F.lit(1)).alias("_n"))
        grown = F.col("_more") + 2 * F.col("_n") - F.when(F.col("chars") == 0, 2).otherwise(0)
        after = state.join(taken, [key, "idx"], "left").withColumn("gone", F.col("gone") | falls)
        state = materialised(after.withColumn("chars", F.col("chars") + F.coalesce(grown, F.lit(0))).drop("_more", "_n"))
    left = state.where("NOT gone")
    no_path = F.array().cast("array<struct<level:int,idx:bigint>>")
    owned = [left.select(key, "idx", F.col("idx").alias("owner"), no_path.alias("path"))]
    for level in levels[1:]:  # owners from the top down; the path is the order of a text inside its owner's
        moved = state.where((F.col("level") == level) & F.col("gone")).select(key, "idx", F.col("parent").alias("_p"), "level")
        above = union_all(owned).select(key, F.col("idx").alias("_p"), "owner", "path")
        step = F.array(F.struct((-F.col("level")).cast("int").alias("level"), "idx"))
        owned.append(materialised(moved.join(above, [key, "_p"]).select(key, "idx", "owner", F.concat("path", step).alias("path"))))
    parts = texts.select(key, "idx", "content").join(union_all(owned), [key, "idx"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("path", "content")))), lambda x: x["content"]), "\n\n")
    whole = parts.groupBy(key, F.col("owner").alias("idx")).agg(joined.alias("content"), (F.count(F.lit(1)) - 1).alias("merged"))
    wired = with_parents(left.select(key, "idx", "level", tokens_of(F.col("chars")).alias("tokens")), key, levels)
    return wired.join(whole, [key, "idx"]).select(key, "idx", "level", "parent", "tokens", "merged", "content")
