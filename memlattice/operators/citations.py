"""Titles in texts: an exact substring join that meets on hashed byte windows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.sources.sinks import materialised

#: Window sizes; a title is met by its first bytes, as many as the largest size that it has.
SIZES = (4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64)
#: Bits of the table of title windows that every text's windows are looked up in, at least and at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Bits of that table per title, at least half as many after rounding; and bytes of texts that are hashed at a time.
TITLE_BITS, STRETCH = 64, 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Workers get these functions themselves, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _windows(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every window of `size` bytes that ends inside its text; ends[i] is where the text of byte i ends."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n) + size <= ends[:n])
    h = np.full(len(at), np.uint64(size), np.uint64)
    for k in range(0, size, 4):  # four bytes at a time
        word = np.zeros(len(at), np.uint64)
        for j in range(min(4, size - k)):
            word = word << np.uint64(8) | raw[at + k + j]
        h = (h ^ word) * _MULT
        h ^= h >> np.uint64(29)
    return at, h.view(np.int64)


def _title_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for title in batch.column("title").to_pylist():
            data = title.encode()
            size = max(s for s in SIZES if s <= len(data))
            raw = np.frombuffer(data[:size], np.uint8)
            keys.append(int(_windows(raw, np.full(size, size), size)[1][0]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("title"), pa.array(keys, pa.int64())], names=["doc", "title", "key"])


def _text_keys(table: bytes, sizes: tuple[int, ...]):
    """A function of batches (id, text) that keeps the windows whose hash has its bit in the table."""
    bits = np.uint64(len(table) * 8 - 1)

    def passing(known: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for size in sizes:
            at, h = _windows(raw, ends, size)
            place = h.view(np.uint64) >> np.uint64(7) & bits
            hit = (known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield at[hit], h[hit]

    def flush(known: np.ndarray, ids: pa.Array, rows: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The keys of some texts: short ones together, a long one a stretch at a time."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        last = np.cumsum(np.array([len(t) for t in texts], np.int64))
        ends = np.repeat(last, np.diff(last, prepend=0))
        found = []
        for lo in range(0, len(raw), STRETCH):
            hi = min(lo + STRETCH + max(sizes, default=1) - 1, len(raw))
            found += [(np.searchsorted(last, at + lo, side="right"), h) for at, h in passing(known, raw[lo:hi], np.minimum(ends[lo:hi], hi) - lo)]
        text, keys = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((keys, text))
        text, keys = text[order], keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
        if len(keys):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(rows)[text[first]])), pa.array(keys[first])], names=["id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table, np.uint8)
        for batch in batches:
            rows, texts, size = [], [], 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                if texts and size + len(data) > STRETCH:
                    yield from flush(known, batch.column("id"), rows, texts)
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(data)
                size += len(data)
            yield from flush(known, batch.column("id"), rows, texts)

    return run


def _bit_table(keys: DataFrame, bits: int) -> bytes:
    """One bit per title window; the rows that reach the driver are words of 32 bits, `bits` / 32 at most."""
    place = F.shiftrightunsigned("key", 7).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(place, 5).cast("int").alias("w"), F.pmod(place, F.lit(32)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    rows = words.toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint64).astype(np.uint32)
    return out.tobytes()


def cited_documents(texts: DataFrame, titles: DataFrame, least: int = 4) -> DataFrame:
    """(id, doc): documents whose normalised title of `least` characters or more occurs anywhere in a text.

    `texts` has id and text, `titles` doc and title; both are lower-cased with single spaces, titles without punctuation
    at their ends.  A title's key is the hash of its first bytes, as many as the largest of SIZES it has.  Every window of those sizes of
    every text is hashed where the text is read, and looked up in a table of bits that is broadcast (32 to 64 a title, 8 KB
    to 16 MB); those that pass are joined with the titles by key, and the whole title is then checked in the text.  With more titles
    than the table has room for, more windows are joined and the result is the same.

    Defined results: null texts, titles and ids give no rows; repeated rows give one; an empty side gives none.
    """
    known = titles.where("doc IS NOT NULL AND title IS NOT NULL").select("doc", X.normal_title(F.col("title")).alias("title")).where(F.length("title") >= least).distinct()
    kinds = f"doc {titles.schema['doc'].dataType.simpleString()}, title string, key long"
    named = materialised(known.where(F.octet_length("title") >= min(SIZES)).mapInArrow(_title_keys, kinds))
    size = max((s for s in (1 << k for k in range(16, 28)) if s <= max(TITLE_BITS * named.count(), LEAST_BITS)), default=LEAST_BITS)
    used = sorted(r.n for r in named.select(F.octet_length("title").alias("n")).select(F.greatest(*[F.when(F.col("n") >= s, F.lit(s)).otherwise(0) for s in SIZES]).alias("n")).distinct().collect())
    body = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("text"))
    keys = body.mapInArrow(_text_keys(_bit_table(named, min(size, MOST_BITS)), tuple(used)), f"id {texts.schema['id'].dataType.simpleString()}, key long")
    # the titles that may be in a text are gathered, so a text meets them in one row
    pairs = keys.join(named, "key").groupBy("id").agg(F.collect_set(F.struct("doc", "title")).alias("_t"))
    inside = F.filter("_t", lambda t: F.contains(F.col("text"), t["title"]))
    return pairs.join(body, "id").select("id", F.explode(F.transform(inside, lambda t: t["doc"])).alias("doc")).distinct()
