"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

The unit placed is a group, the rows of one text.  Each group goes to the shard whose
residual capacity (as shares of the fair bytes, tokens and rows) has the highest
dot product with the group's own vector; shards without room for the group's
bytes come last.

One scan of the texts leaves a narrow table (id, bytes, tokens, digest); all else works on
that.  Two levels keep the placing parallel.  Groups are dealt by hash over cells, of
which there are more for more rows; each cell streams its groups, largest first, into its
own bins by the rule above, with constant memory.  Then the cells' bins (at most
`MOST_CELLS * BINS` vectors, whatever the data) are placed into the shards by the
same rule, largest first.

Groups stay whole as long as the law can hold: only a group of more bytes than
`split_above` fair shards, which no placing could balance, is cut, into pieces of about a
`split`th of a shard, by a hash of the row's id.  `split_above=None` keeps those too.

Slots are numbered without a gap from 0 in each shard from counters within each
task plus offsets per task.

Defined results: a null text has size 1, tokens 0 and counts as empty; rows that repeat are placed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.packing import text_slices
from memlattice.llm.shared import INT, LONG, partitions_for, schema, ship, written
from memlattice.llm.wordbpe import default_vocabulary, encoder

#: Cells at least and at most, rows of a cell in between, bins of a cell and pieces of a shard.
CELLS, MOST_CELLS, CELL_ROWS, BINS, SPLIT = 256, 16_384, 1 << 16, 16, 64
#: Groups of most rows that are joined by broadcast.
LARGEST = 1024


class Bins:
    """Residual capacities; `place` puts one vector by the dot-product rule."""

    def __init__(self, capacity: np.ndarray, bins: int):
        self.fair = np.maximum(capacity / bins, 1e-9)
        self.left = np.ones((bins, len(capacity)))

    def place(self, vector: np.ndarray) -> int:
        need = vector / self.fair
        score = self.left @ need
        fits = self.left[:, 0] >= need[0]
        if fits.any():
            score = np.where(fits, score, -np.inf)
            best = int(np.argmax(score))
        else:
            best = int(np.argmax(self.left[:, 0]))
        self.left[best] -= need
        return best


GROUP = schema(_h=LONG, _g=LONG, _piece=INT, cell=INT, bin=INT, n_bytes=LONG, n_tokens=LONG, n_rows=LONG)


def _binned(groups: DataFrame, bins: int, capacity: np.ndarray) -> DataFrame:
    """Groups of a cell, sorted by size, streamed into the cell's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None
        for batch in batches:
            vectors = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_bytes", "n_tokens", "n_rows")], axis=1).astype(float)
            out = []
            for c, v in zip(batch.column("cell").to_pylist(), vectors, strict=True):
                if c != cell:
                    cell, held = c, Bins(capacity, bins)
                out.append(held.place(v))
            named = {f: batch.column(f) for f in GROUP.names if f != "bin"} | {"bin": pa.array(out, pa.int32())}
            yield pa.RecordBatch.from_arrays([named[f] for f in GROUP.names], names=GROUP.names)

    return groups.mapInArrow(run, GROUP)


MEASURED = schema(doc_id=LONG, size=LONG, text_crc32=LONG, _h=LONG, _g=LONG, _tokens=LONG)


def measured(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes plus one, crc32, 120-bit digest (_h, _g) and number of token ids of every text."""
    text = F.col(text_col).cast("string")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_h"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("_g"),
        text.alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for lo, hi in text_slices(batch.column("_text")):
                _, at = enc.encode_column(batch.column("_text").slice(lo, hi - lo))
                kept = [batch.column(c).slice(lo, hi - lo) for c in MEASURED.names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at).astype(np.int64))], names=MEASURED.names)

    ship(docs.sparkSession)
    return rows.mapInArrow(run, MEASURED)


def vector_shards(
    docs: DataFrame, shards: int, vocabulary: str | None = None, split_above: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, bins: int = BINS, split: int = SPLIT
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    rows = written(measured(docs, vocabulary or default_vocabulary(), id_col, text_col), "measured")
    total = rows.agg(F.sum("size"), F.sum("_tokens"), F.count(F.lit(1))).first()
    capacity = np.array([float(x or 0) for x in total])
    cells = cells or min(max(CELLS, 1 << (int(capacity[2]) // CELL_ROWS).bit_length()), MOST_CELLS)
    pieces = F.lit(0)
    if split_above is not None:
        large = rows.groupBy("_h", "_g").agg(F.sum("size").alias("_all")).where(F.col("_all") * shards > capacity[0] * split_above)
        large = large.select("_h", "_g", F.ceil(F.col("_all") / F.lit(max(capacity[0], 1)) * shards * split).alias("_pieces"))  # fewer than shards / split_above
        rows = rows.join(F.broadcast(large), ["_h", "_g"], "left")
        pieces = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int"), F.lit(0))
    rows = rows.withColumn("_piece", pieces)
    groups = rows.groupBy("_h", "_g", "_piece").agg(F.sum("size").alias("n_bytes"), F.sum("_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("_h", "_g", "_piece"), F.lit(cells)).cast("int"))
    dealt = groups.repartition(min(cells, partitions_for(groups)), "cell").sortWithinPartitions("cell", F.desc("n_bytes"), "_h", "_g", "_piece")
    placed = written(_binned(dealt, bins, capacity / cells), "bins")
    sums = placed.groupBy("cell", "bin").agg(F.sum("n_bytes"), F.sum("n_tokens"), F.sum("n_rows")).collect()  # cells * bins rows at most
    final, chosen = Bins(capacity, shards), []
    for r in sorted(sums, key=lambda r: (-r[2], r[0], r[1])):
        chosen.append((r[0], r[1], final.place(np.array(r[2:], float))))
    names = spark.createDataFrame(chosen, schema(cell=INT, bin=INT, shard=INT))
    homes = placed.join(F.broadcast(names), ["cell", "bin"]).select("_h", "_g", "_piece", "shard", "n_rows")
    key = ["_h", "_g", "_piece"]
    largest = homes.orderBy(F.desc("n_rows"), *key).limit(LARGEST).select(*key, F.col("shard").alias("_shard"))
    met = rows.select("doc_id", "size", "text_crc32", *key).join(F.broadcast(largest), key, "left")
    rest = met.where("_shard IS NULL").drop("_shard").join(homes.drop("n_rows"), key)
    out = ["doc_id", "size", "text_crc32"]
    return numbered(met.where("_shard IS NOT NULL").select(*out, F.col("_shard").alias("shard")).union(rest.select(*out, "shard")), shards)


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, to rows with a column shard."""
    spark = rows.sparkSession
    out = schema(doc_id=LONG, size=LONG, text_crc32=LONG, shard=INT, _nth=LONG, _part=INT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            nth = np.empty(len(shard), np.int64)
            for s in range(shards):
                own = shard == s
                nth[own] = seen[s] + np.arange(own.sum())
                seen[s] += own.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(np.full(len(shard), part, np.int32))], names=out.names)

    ship(spark)
    counted = written(rows.mapInArrow(count, out), "slots")
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = counted.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))  # shards rows per task
    offsets = per_task.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return counted.join(offsets, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_nth") + F.col("_before")).alias("slot"))
