"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A bin is filled greedily with the longest document that fits; when nothing
fits any more, its smallest document gives way to two unpacked ones whenever
their sum fills the widened gap more tightly.

Bins are decided on the histogram of lengths, of which there are at most
`capacity`: a bin's pattern is repeated as often as the histogram allows, so the
decision costs the driver the same for any number of documents and packs all
of them together.  Documents then find their places by their rank within their
length: ranks come from counters within each task plus per-task offsets, so no
length, however common, is one task's work.

Defined results: a null or empty text is a document of the end id alone; rows
that repeat are packed each; an empty table gives no rows; other columns are
ignored; a document longer than the capacity is cut into full pieces and a
last, possibly shorter one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.shared import INT, LONG, narrow, schema, ship, written
from memlattice.llm.wordbpe import default_vocabulary, encoder

CAPACITY = 2048
#: Documents encoded at once in a task.
BATCH_BYTES = 2 << 20

PIECES = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, part=INT, nth=LONG)


def text_slices(col: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch that hold about `limit` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(col)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece, with its number `nth` among pieces of its length in its task `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi in text_slices(batch.column("text")):
                some = batch.slice(lo, hi - lo)
                ids, at_row = enc.encode_column(some.column("text"))
                ids, bounds, out = ids.astype("<u4"), at_row.tolist(), []
                for doc, a, b in zip(some.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    raw = np.append(ids[a:b], np.uint32(end_id))
                    for k, at in enumerate(range(0, len(raw), capacity)):
                        piece = raw[at : at + capacity]
                        n = len(piece)
                        out.append((doc, k, at, n, zlib.crc32(piece.tobytes()), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE_ARROW, strict=True)], names=PIECES.names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, PIECES)


_PIECE_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bin patterns ({length: copies}, repetitions) that use up the histogram.

    Every length is from 1 to `capacity`.
    """
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    lengths = sorted(left)
    plan: list[tuple[dict[int, int], int]] = []
    while lengths:
        used: Counter = Counter()
        gap = _fill(left, lengths, used, capacity)
        while gap > 0 and sum(used.values()) > 1:
            small = min(used)
            pair = _two(left, lengths, used, gap + small, small)
            if pair is None:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            used.update(pair)
            gap = _fill(left, lengths, used, gap + small - sum(pair))
        times = min(left[n] // k for n, k in used.items())
        plan.append((dict(sorted(used.items(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return plan


def _fill(left: Counter, lengths: list[int], used: Counter, gap: int) -> int:
    at = bisect_right(lengths, gap) - 1
    while at >= 0 and gap > 0:
        n = lengths[at]
        k = min(gap // n, left[n] - used[n])
        if k > 0:
            used[n] += k
            gap -= k * n
        at = min(at - 1, bisect_right(lengths, gap) - 1)
    return gap


def _two(left: Counter, lengths: list[int], used: Counter, room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over `least` and at most `room`."""
    best, found = least, None
    lo, hi = 0, bisect_right(lengths, room) - 1
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if a + b > room or left[b] - used[b] < 1:
            hi -= 1
        elif left[a] - used[a] < 1 + (a == b):
            lo += 1
        else:
            if a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            lo += 1
    return found


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (see PIECES)."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["_c"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_c")).collect()}
    rows, sequence, next_rank = [], 0, Counter()
    for pattern, times in best_two_fit(histogram, capacity):
        offset = 0
        for n, k in pattern.items():
            rows.append((n, next_rank[n], k, sequence, offset))
            next_rank[n] += k * times
            offset += k * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # a few rows per length at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_before")).alias("rank"))
    out = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, sequence_id=LONG, offset=LONG)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = plan[:, 0] * (1 << 48) + plan[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(key, n * (1 << 48) + rank, side="right") - 1]
            nth, k = rank - row[:, 1], row[:, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + nth // k), pa.array(row[:, 4] + nth % k * n)], names=out.names)

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = tokenised_pieces(narrow(docs, id_col, text_col), vocabulary or default_vocabulary(), capacity, end_id)
    return pack_pieces(written(pieces, "pieces"), capacity)
