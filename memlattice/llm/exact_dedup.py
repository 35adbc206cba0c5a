"""Exact de-duplication by progressive refinement, in DataFrame operations only.

Rows are grouped by text length; what shares a length is refined by a hash of
the text's beginning, and what still shares a group by a hash of the whole text.
Each level's groups of two or more go into a bitmap of fixed size that the next
scan looks up: rows it rules out are settled there and never hashed further.  A
row that the bitmap lets pass by chance is only counted exactly one level deeper,
where it is alone.  `drop_exact_duplicates` hashes whole texts of surviving rows
and of nothing else; `exact_dedup` reports every text's SHA-256, which its last
scan takes, once a row.

Texts never travel and counts combine before every shuffle.  The 1,024 largest
groups of equal texts are joined by broadcast (a fixed number of rows), so no key
that is shuffled holds more than one row in 1,025.

Defined results: a null text counts as empty; an empty table gives an empty
result; rows that repeat id and text are all members of their group and all
carry the kept flag of that id; a null id is never kept while another id is
in its group, and is kept if alone.  `drop_exact_duplicates` leaves one row of each
group, also of repeated rows or null ids: the one whose JSON form comes first.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.membership import bitmap, flagged, without_rows
from memlattice.llm.shared import text_or_empty

#: Characters of a text's beginning in the second level's hash.
PREFIX_CHARS = 64
#: Bitmap buckets of 32,768 bits of the two coarse levels; there are far fewer lengths than beginnings.
LENGTH_BUCKETS, HEAD_BUCKETS = 8, 256
#: Largest groups that are joined by broadcast.
LARGEST = 1024


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def refined(rows: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Rows (doc_id, _t) with _close: false where no other text has the same length and beginning."""
    sized = rows.withColumn("_len", F.octet_length("_t"))
    lengths = bitmap(_counted(sized.select("_len"), "_len").select(F.xxhash64("_len")), LENGTH_BUCKETS)
    level = flagged(sized, lengths, F.xxhash64("_len"), "_alike", LENGTH_BUCKETS)
    headed = level.withColumn("_head", F.when(F.col("_alike"), F.xxhash64(F.substring("_t", 1, prefix_chars))))
    heads = _counted(headed.where("_alike").select("_len", "_head"), "_len", "_head")
    starts = bitmap(heads.select(F.xxhash64("_len", "_head")), HEAD_BUCKETS)
    return flagged(headed, starts, F.xxhash64("_len", "_head"), "_close", HEAD_BUCKETS)


def equal_groups(close: DataFrame) -> DataFrame:
    """(_sha, _keep, _size) of texts that two rows or more of (doc_id, _sha) have."""
    groups = close.groupBy("_sha").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    # never null, so that no join adds a filter that hashes the texts again
    return groups.withColumn("_sha", F.coalesce("_sha", F.lit("")))


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join of rows (doc_id, _sha or null, ...) to their groups; the largest by broadcast."""
    largest = groups.orderBy(F.desc("_size"), "_sha").limit(LARGEST).select(F.col("_sha").alias("_big"), F.col("_keep").alias("_big_keep"), F.col("_size").alias("_big_size"))
    met = rows.join(F.broadcast(largest), F.col("_sha") == F.col("_big"), "left")
    alone = F.concat(F.lit("-"), F.hex(F.xxhash64(*rows.columns)))  # matches no digest and is spread evenly
    keyed = met.withColumn("_k", F.when(F.col("_big").isNull(), F.col("_sha"))).withColumn("_k", F.coalesce("_k", alone))
    joined = keyed.join(groups.withColumnRenamed("_sha", "_k"), "_k", "left")
    return joined.select(*rows.columns, F.coalesce("_big_keep", "_keep").alias("_keep"), F.coalesce("_big_size", "_size").alias("_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `normalise` is the text to compare (default: the text itself).  The row with
    the largest id of equal texts stays.
    """
    text = normalise if normalise is not None else text_or_empty(text_col)
    rows = refined(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t")), prefix_chars)
    groups = equal_groups(rows.where("_close").select("doc_id", _digest(F.col("_t")).alias("_sha")))
    told = rows.select("doc_id", _digest(F.col("_t")).alias("text_sha256"), "_close")
    found = _grouped(told.select("doc_id", "text_sha256", F.when(F.col("_close"), F.col("text_sha256")).alias("_sha")), groups)
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """`docs` with one row of each group of equal texts, that of the largest id."""
    text = text_or_empty(text_col)
    rows = refined(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t")), prefix_chars)
    close = rows.where("_close").select("doc_id", _digest(F.col("_t")).alias("_sha"), F.xxhash64("_t").alias("_hash"))
    copies = close.groupBy("doc_id", "_sha", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    once = F.col("doc_id").eqNullSafe(F.col("_keep"))
    marks = _grouped(copies, equal_groups(close)).where(F.col("_size").isNotNull() & (~once | (F.col("_copies") > 1)))
    return without_rows(docs, marks.select("doc_id", F.col("_hash").alias("digest"), once.alias("once")), F.xxhash64(text), id_col)
