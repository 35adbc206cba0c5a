"""Token-id files coded by a static range asymmetric numeral system (rANS).

File format: Parquet rows (part, block, first, tokens, frame).  A frame holds the
ids of whole consecutive documents and decodes on its own:

    magic "RNB1", then little-endian u32: tokens n, documents d, lanes k,
    tokens between checkpoints t, checkpoints c, words w, crc32 of the shared
    table, crc32 of all that follows
    d x i64 document ids, d x u32 document lengths, c x u32 positions in the
    words, c x k x u32 lane states, c x u32 crc32 of each segment's ids, w x u16 words

Token i of a frame is coded by lane i mod k.  A checkpoint has all lane states and
the word position before its first token, so the segments of a frame decode in
parallel and are checked one by one.  The frequency table is shared by all
frames: counts of all ids of the corpus scaled to 2^16 slots, none below 1.

Texts are encoded where they are read; what is shuffled is their ids, 16 bits each.
Files are in ascending document order: ranges of the document ids, from a
quantile sketch, give `part`, and `block` counts within it.

Defined results: a null or empty text is the end id alone; rows that repeat an
id follow one another; null ids come first; an empty table gives no rows; other
columns are ignored; a document longer than a block makes a longer block; an id
of 2^16 or more raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.packing import text_slices
from memlattice.llm.shared import BIN, INT, LONG, Scratch, narrow, partitions_for, schema, scratch_path, ship
from memlattice.llm.wordbpe import default_vocabulary, encoder

MAGIC = b"RNB1"
_HEAD = struct.Struct("<4s8I")
_BITS = 16
_ONE = np.uint32(1 << _BITS)
_SHIFT, _LOW = np.uint32(16), np.uint32(0xFFFF)
#: Ids of a block, its lanes, and ids between checkpoints.
BLOCK_TOKENS, LANES, CHECKPOINT = 1 << 17, 1024, 1 << 16


@dataclass(frozen=True)
class Table:
    """Scaled frequencies of ids; they add up to 2^16."""

    freq: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        used = np.flatnonzero(counts)
        if len(counts) > 1 << _BITS:
            raise ValueError(f"ids up to {len(counts) - 1} do not fit a table of 2^{_BITS} slots")
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            share = counts[used] / counts[used].sum() * (1 << _BITS)
            freq[used] = np.maximum(1, np.floor(share)).astype(np.int64)
            order = used[np.argsort(-counts[used], kind="stable")]
            spare = (1 << _BITS) - int(freq.sum())
            if spare > 0:
                freq[order[0]] += spare
            while spare < 0:  # a round at most halves each, so many rare ids take several
                for i in order:
                    if spare >= 0:
                        break
                    take = min(-spare, int(freq[i]) // 2)
                    freq[i] -= take
                    spare += take
            if freq.sum() != 1 << _BITS or freq[used].min() < 1:
                raise AssertionError("frequencies do not fill the table")
        return cls(freq)

    @cached_property
    def coding(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and first slot of each id."""
        start = np.concatenate([[0], np.cumsum(self.freq)[:-1]])
        return self.freq.astype(np.uint32), start.astype(np.uint32)

    @cached_property
    def decoding(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, its frequency and the place within it, of each slot."""
        freq, start = self.coding
        symbol = np.repeat(np.arange(len(freq)), self.freq)
        return symbol.astype(np.uint32), freq[symbol], np.arange(len(symbol), dtype=np.uint32) - start[symbol]

    @cached_property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """The frame of some documents' ids."""
    n, every = len(ids), checkpoint // lanes
    if n and table.freq[ids].min() < 1:
        raise ValueError("an id is not in the frequency table")
    freq, start = (t[ids] for t in table.coding)
    state = np.full(lanes, _ONE, np.uint32)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    count = 0
    for step in range(-(-n // lanes) - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        over = np.flatnonzero((x >> _SHIFT) >= f)
        if len(over):
            high = x[over]
            words.append((high & _LOW).astype("<u2"))
            count += len(over)
            x[over] = high >> _SHIFT
        q = x // f
        state[: len(f)] = (q << _SHIFT) + (x - q * f) + c
        if step % every == 0:
            marks.append((count, state.astype("<u4")))
    marks.reverse()
    body = np.concatenate(words[::-1]) if words else np.zeros(0, "<u2")
    crcs = [zlib.crc32(ids[i : i + checkpoint].astype("<u4").tobytes()) for i in range(0, n, checkpoint)]
    rest = b"".join(
        [
            doc_ids.astype("<i8").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([count - m for m, _ in marks], "<u4").tobytes(),
            *(s.tobytes() for _, s in marks),
            np.array(crcs, "<u4").tobytes(),
            body.tobytes(),
        ]
    )
    return _HEAD.pack(MAGIC, n, len(doc_ids), lanes, checkpoint, len(marks), count, table.crc, zlib.crc32(rest)) + rest


@dataclass(frozen=True)
class Frame:
    """An opened frame; segments decode independently."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    tokens: int
    lanes: int
    checkpoint: int
    positions: np.ndarray
    states: np.ndarray
    crcs: np.ndarray
    words: np.ndarray
    table: Table

    @classmethod
    def open(cls, data: bytes, table: Table) -> Frame:
        magic, n, d, k, t, c, w, table_crc, crc = _HEAD.unpack_from(data)
        rest = memoryview(data)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(rest) != crc:
            raise ValueError("damaged frame")
        if table_crc != table.crc:
            raise ValueError("the frame was written with another frequency table")
        at, out = 0, []
        for kind, size in (("<i8", d), ("<u4", d), ("<u4", c), ("<u4", c * k), ("<u4", c), ("<u2", w)):
            out.append(np.frombuffer(rest, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(out[0], out[1], n, k, t, out[2], out[3].reshape(c, k), out[4], out[5], table)

    def segment(self, i: int) -> np.ndarray:
        """Ids from checkpoint i to the next, checked."""
        first = i * self.checkpoint
        n = min(self.checkpoint, self.tokens - first)
        symbol, freq, place = self.table.decoding
        state, words, at = self.states[i].astype(np.uint32), self.words, int(self.positions[i])
        slots = np.empty(n, np.intp)
        for lo in range(0, n, self.lanes):
            x = state[: min(self.lanes, n - lo)]
            slot = (x & _LOW).astype(np.intp)
            slots[lo : lo + len(slot)] = slot
            x = freq[slot] * (x >> _SHIFT) + place[slot]
            low = np.flatnonzero(x < _ONE)
            if len(low):
                x[low] = (x[low] << _SHIFT) | words[at : at + len(low)]
                at += len(low)
            state[: len(slot)] = x
        out = symbol[slots]
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crcs[i]:
            raise ValueError("ids of a segment do not match their checksum")
        return out

    def ids(self) -> np.ndarray:
        parts = [self.segment(i) for i in range(len(self.positions))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


RAW = schema(part=INT, block=INT, first=LONG, tokens=LONG, doc_ids=BIN, lengths=BIN, ids=BIN)
CODED = schema(part=INT, block=INT, first=LONG, tokens=LONG, frame=BIN)


def _planes(ids: np.ndarray) -> bytes:
    """Low bytes, then high bytes: general compressors do better on them."""
    if len(ids) and int(ids.max()) >> 16:
        raise ValueError(f"id {int(ids.max())} does not fit 16 bits")
    return np.ascontiguousarray(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2")[:, 0]


TOKENS = schema(part=INT, doc_id=LONG, n=LONG, ids=BIN)


def id_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Upper ends of `parts` ranges of doc_id with about as many rows each, from a quantile sketch of the ids.

    Only the id column is read; sketch and bounds follow the number of partitions.
    """
    shares = [i / parts for i in range(1, parts)]
    found = docs.approxQuantile("doc_id", shares, 1 / (4 * parts)) if shares else []
    return np.unique(np.clip(found, -(2.0**62), 2.0**62).astype(np.int64))


def token_rows(docs: DataFrame, vocabulary: str, end_id: int, uppers: np.ndarray) -> DataFrame:
    """Ids of each (doc_id, text) with the end id, in byte planes, and the id range of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for lo, hi in text_slices(batch.column("text")):
                some = batch.slice(lo, hi - lo)
                ids, at = enc.encode_column(some.column("text"))
                bounds = at.tolist()
                data = [_planes(np.append(ids[a:b], enc.dtype.type(end_id))) for a, b in zip(bounds, bounds[1:], strict=False)]
                names = some.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
                part = np.searchsorted(uppers, names).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), some.column("doc_id"), pa.array(np.diff(at) + 1), pa.array(data, pa.binary())], names=TOKENS.names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, TOKENS)


def ordered_blocks(tokens: DataFrame, parts: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of `token_rows` in ascending doc_id order, one partition for each id range, in blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        block = first = size = 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.array([len(x) for x in held], "<u4")
            known = np.array([np.iinfo(np.int64).min if x is None else x for x in names], "<i8")
            row = (part, block, first, len(ids), known.tobytes(), lengths.tobytes(), _planes(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _RAW_ARROW, strict=True)], names=RAW.names)

        for batch in batches:
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                held.append(_unplaned(data))
                names.append(doc)
                size += n
                if size >= block_tokens:
                    yield flush()
                    first, block, size, held, names = first + size, block + 1, 0, [], []
        if held:
            yield flush()

    ranged = tokens.repartitionById(parts, "part").sortWithinPartitions("doc_id")
    return ranged.mapInArrow(run, RAW)


_RAW_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def frequency_table(raw: DataFrame) -> Table:
    """Counts of all ids of the blocks; at most one row per id of the vocabulary reaches the driver."""
    counted = schema(id=INT, n=LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.bincount(_unplaned(x.as_py()), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=counted.names)

    counts = np.zeros(1 << _BITS, np.int64)
    for r in raw.select("ids").mapInArrow(count, counted).groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return Table.from_counts(counts)


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """Tokenise `docs` and write coded files to `path`; returns the shared table."""
    spark = docs.sparkSession
    blocks, plain = Scratch(spark), narrow(docs, id_col, text_col)
    parts = partitions_for(plain)
    tokens = token_rows(plain, vocabulary or default_vocabulary(), end_id, id_bounds(plain, parts))
    raw = blocks.written(ordered_blocks(tokens, parts), "ids", compression="zstd")
    table = frequency_table(raw)
    shared = spark.sparkContext.broadcast(table)  # 2^16 frequencies

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                ids, lengths, ints = (row.column(c)[0].as_py() for c in ("ids", "lengths", "doc_ids"))
                plain = _unplaned(ids)
                lanes = min(LANES, 1 << (len(plain) // 256).bit_length())  # few lanes for few ids
                frame = encode_frame(np.frombuffer(ints, "<i8"), np.frombuffer(lengths, "<u4"), plain, shared.value, lanes)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "block", "first", "tokens")), pa.array([frame], pa.binary())], names=CODED.names)

    raw.mapInArrow(code, CODED).write.option("compression", "none").parquet(path)
    blocks.clear()
    return table


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODED).parquet(path)


def document_index(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    frames = read_frames(spark, path)
    sums = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}  # one row per partition
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]
    shared = spark.sparkContext.broadcast((table, base))
    out = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        for batch in batches:
            for part, first, data in zip(*(batch.column(c) for c in ("part", "first", "frame")), strict=True):
                frame = Frame.open(data.as_py(), table)
                raw, lengths = frame.ids().astype("<u4").tobytes(), frame.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                at = [0, *(ends * 4).tolist()]
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
                ids = pa.array(frame.doc_ids, mask=frame.doc_ids == np.iinfo(np.int64).min)
                starts = ends - lengths + first.as_py() + base[part.as_py()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=out.names)

    return frames.select("part", "first", "frame").mapInArrow(decode, out)


def encode_and_read(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and read its index back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "rans")
    return document_index(spark, path, write_store(docs, path, vocabulary, end_id))
