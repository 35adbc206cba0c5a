"""Splitting a wide table by a set of keys without shuffling rows outside the set.

A bitmap of fixed size over hashed keys is the only thing broadcast; its size is
a parameter and does not follow the data.  Rows it rules out pass by untouched;
the others go through an exact join.  As the set outgrows the bitmap, more rows
take the exact join and the result stays the same.

A table's own columns travel as one struct, so their names, whatever they are, meet
no name used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.shared import written

#: Buckets of 32,768 bits (4 KB each): 4 MB of bitmap.
BUCKETS = 1024
_BITS = 32_768


def bitmap(hashes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(_bucket, _bits) of the rows' 64-bit hashes (one column)."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(buckets * _BITS))
    return hashes.select(place.alias("_p")).groupBy(F.expr(f"_p div {_BITS}").alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(_p % {_BITS})").alias("_bits"))


def flagged(rows: DataFrame, bits: DataFrame, hashed: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    """`rows` with a boolean: false where `hashed` is certainly not among the bitmap's hashes."""
    placed = rows.withColumn("_p", F.pmod(hashed, F.lit(buckets * _BITS))).withColumn("_bucket", F.expr(f"_p div {_BITS}"))
    byte = f"cast(conv(hex(substring(_bits, cast((_p % {_BITS}) div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce((shiftright({byte}, cast(_p % 8 as int)) & 1) = 1, false)")
    return placed.join(F.broadcast(bits), "_bucket", "left").withColumn(name, hit).drop("_bucket", "_p", "_bits")


def _packed(docs: DataFrame, id_col: str, **more: Column) -> DataFrame:
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("_row"), F.col(id_col).cast("long").alias("_id"), *(c.alias(n) for n, c in more.items()))


def without_rows(docs: DataFrame, marks: DataFrame, digest: Column, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """`docs` without the rows that `marks` (doc_id, digest, once) names.

    A row is named by its id and the digest of its content, a column over `docs`
    that is evaluated only where the id may be marked; so rows that share an id are told
    apart.  Of the rows with one mark none stays, or, where `once` is true, one:
    that whose JSON form comes first.
    """
    marks = written(marks.select(F.col("doc_id").cast("long").alias("_mark"), F.col("digest").alias("_digest"), F.col("once").alias("_once")).distinct(), "marks")
    bits = bitmap(marks.select(F.xxhash64("_mark")), buckets)
    rows = flagged(_packed(docs, id_col, _text=digest), bits, F.xxhash64("_id"), "_maybe", buckets)
    met = rows.where("_maybe").join(marks, F.col("_id").eqNullSafe(F.col("_mark")) & F.col("_text").eqNullSafe(F.col("_digest")), "left")
    stay = rows.where("NOT _maybe").select("_row").union(met.where("_once IS NULL").select("_row"))
    if not marks.where("_once").isEmpty():
        stay = stay.union(met.where("_once").groupBy("_id", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return stay.select("_row.*")


def with_ids(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of `docs` joined to `table` (doc_id and other columns) on the id."""
    bits = bitmap(table.select(F.xxhash64(F.col("doc_id").cast("long"))), buckets)
    rows = flagged(_packed(docs, id_col), bits, F.xxhash64("_id"), "_maybe", buckets).where("_maybe")
    others = [c for c in table.columns if c != "doc_id"]
    return rows.join(table.withColumnRenamed("doc_id", "_key"), F.col("_id") == F.col("_key")).select("_row.*", *others)
