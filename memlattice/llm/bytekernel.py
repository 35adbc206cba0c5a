"""Vectorised word splitting, word hashing and shingling over Arrow text columns.

The helpers below run inside Spark tasks on one Arrow batch at a time.  They
work on the UTF-8 bytes of a string column, so a batch costs a handful of numpy
passes and no Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are
lower-cased first.  Word identity is a 64-bit hash (random byte codes, a
polynomial in an odd multiplier and a final mix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_CODE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER_CODE = _CODE[_LOWER]

#: Bytes of text worked on at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(4096)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte and length of each word, index of each row's first word and the total at the end)."""
    n = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    inside = _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a row begins here, so no word runs on
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.cumsum(inside)[starts] - 1
    lens = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lens)
    longest = int(lens.max())
    power = _POW if longest <= len(_POW) else _powers(longest)
    hashes = mix64(np.add.reduceat(_LOWER_CODE[raw[at]] * power[within], first))
    return hashes, starts, lens, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the total at the end)."""
    hashes, _, _, rows = word_spans(raw, offsets)
    return hashes, rows


def byte_hashes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of byte runs that follow one another without a gap, letters as they are."""
    longest = int(lens.max())
    power = _POW if longest <= len(_POW) else _powers(longest)
    within = np.arange(len(raw)) - np.repeat(starts, lens)
    return mix64(np.add.reduceat(_CODE[raw] * power[within], starts))


_MULT = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values."""
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _MULT[k % 64] + np.uint64(k)
    return mix64(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, no word none."""
    if len(words) == 0:
        return words
    return np.unique(sequence_hash(words, min(width, len(words))))
