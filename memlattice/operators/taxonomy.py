"""Class hierarchies: halves put together, members of deprecated classes, overlays of keyed tables.

Defined results: null names are left out; empty tables give empty tables, but an overlay whose prefix
matches no key raises ValueError, since it would leave old values in place unseen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_classes(*parts: DataFrame) -> DataFrame:
    """(class, subclass): the union of parts (class, subclass); a class without subclasses, be it only named as one, has one row with a null.

    A class may come under several others, in one part or in several.
    """
    rows = reduce(DataFrame.unionByName, [p.select("class", "subclass") for p in parts])
    pairs = rows.where("class IS NOT NULL AND subclass IS NOT NULL").distinct()
    named = rows.select(F.explode(F.array("class", "subclass")).alias("class")).where("class IS NOT NULL").distinct()
    leaves = named.join(pairs, "class", "left_anti").withColumn("subclass", F.lit(None).cast("string"))
    return pairs.unionByName(leaves)


def merged_properties(*parts: DataFrame) -> DataFrame:
    """(name, domain, range): the last part that has a property decides; within a part the least of several."""
    numbered = [p.select("name", F.struct(F.lit(-i).alias("at"), "domain", "range").alias("_v")) for i, p in enumerate(parts)]
    best = reduce(DataFrame.unionByName, numbered).where("name IS NOT NULL").groupBy("name").agg(F.min("_v").alias("_v"))
    return best.select("name", "_v.domain", "_v.range")


def reassigned(edges: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(s, p, o, moved): edges after members of deprecated classes went to the parent.

    `deprecated` has `class`.  The parent is the first by name of the class's subClassOf edges; members of a class without one stay.
    A class moves one level a pass, also to a parent that is deprecated itself.  Where a member already has the parent, one edge is left.
    """
    rows = edges.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    gone = deprecated.select(F.col("class").alias("s")).where("s IS NOT NULL").distinct()
    parents = rows.where("p = 'subClassOf'").join(gone, "s", "left_semi").groupBy(F.col("s").alias("o")).agg(F.min("o").alias("_parent"))
    typed = rows.where("p = 'instanceOf'").join(parents, "o", "left")
    typed = typed.select("s", "p", F.coalesce("_parent", "o").alias("o"), F.col("_parent").isNotNull().alias("moved"))
    others = rows.where("p <> 'instanceOf'").withColumn("moved", F.lit(False))
    return typed.groupBy("s", "p", "o").agg(F.max("moved").alias("moved")).unionByName(others)


def overlaid(base: DataFrame, source: DataFrame, prefixes: list[str]) -> DataFrame:
    """(key, value, overlaid): a keyed table in which the keys of some prefixes take, or get, the source's values."""
    if not prefixes:
        return base.select("key", "value", F.lit(False).alias("overlaid"))
    found = source.agg(*[F.max(F.col("key").startswith(p)) for p in prefixes]).first()
    empty = [p for p, there in zip(prefixes, found, strict=True) if not there]
    if empty:
        raise ValueError(f"no key of the source begins with {', '.join(map(repr, empty))}")
    under = reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes])
    new = source.where(under).select("key", "value", F.lit(True).alias("overlaid"))
    return base.join(new, "key", "left_anti").select("key", "value", F.lit(False).alias("overlaid")).unionByName(new)
