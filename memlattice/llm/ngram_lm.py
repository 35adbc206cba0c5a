"""Interpolated modified Kneser-Ney n-gram model over the whole corpus, of order three or two.

Counting runs in Spark; the model is a folder of sorted arrays that the
scoring tasks memory-map:

* words-<b>: word hashes in ascending order, bucketed by their top bits, with
  counts; a word's id is its rank over all buckets;
* <k>-<b>, for orders k from 2 up: contexts (the ids of k - 1 words) in ascending order
  of a one-to-one hash, in the bucket of another, each with the sum of its counts, the numbers of
  words counted once and twice after it, and its followers' ids, ascending, with counts;
  contexts of one follower that was counted once are kept apart, with that id only;
* after-<b>: per word, the number of different words it follows.

Counts of the highest order are occurrences; a lower order counts the different words
before a sequence, but occurrences where the sequence begins a text, as nothing is before it.

Tasks combine counts before anything is shuffled: they travel as sorted,
delta-coded blobs per bucket and are merged by streaming.  There are as many buckets as
64 MB parts of input, up to 2^18.  Files are written under a name of their own and
renamed, so a repeated task leaves the same model.

A text is its words (bytes other than space and 0x09-0x0D, A-Z lower-cased)
and one end token.  With c the counts of an order, h the context and h' the same
without its first word, D the modified Kneser-Ney discounts of the order,

    p(w|h) = max(c(h,w) - D(c(h,w)), 0) / c(h) + g(h) p(w|h')
    p(w)   = max(a(w) - D'(a(w)), 0) / A + g' / (V + 1)

and a context never seen leaves p(w|h').

Defined results: a null or empty text is the end token alone; rows that repeat are
scored (and learned) each; without training text every probability is 1 / (V + 1);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.bytekernel import mix64, row_blocks, text_bytes, word_hashes
from memlattice.llm.shared import BIN, BOOL, DBL, INT, LONG, partitions_for, posix_path, schema, scratch_path, ship

#: Hashes of the end token and of the beginning of a text; no word hash is likely to equal them.
END, BEGIN = np.uint64(0xFFFFFFFFFFFFFFF1), np.uint64(0x0000000000000007)
#: Pairs a task gathers before it sends them on.
GATHER = 1 << 21
#: Tokens scored at once, or a longer text: n-grams that repeat within them are looked up once.
SCORE_TOKENS = 1 << 19


def buckets_for(parts: int) -> int:
    """A power of two, as many as there are input partitions, from 16 to 2^18."""
    return 1 << min(18, max(4, (parts - 1).bit_length()))


def tokens_of(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of words and ends, index of each row's first token) by block."""
    raw, offsets = text_bytes(col)
    for lo, hi in row_blocks(offsets):
        h, at = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        rows = hi - lo
        ends = at[1:] + np.arange(rows)
        out = np.empty(len(h) + rows, np.uint64)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word] = h
        out[~is_word] = END
        yield lo, hi, out, at + np.arange(rows + 1)


def joined_tokens(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of words and ends, index of each row's first token) of neighbouring blocks, up to about SCORE_TOKENS tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum([0] + [len(tokens) for tokens, _ in held])
        return np.concatenate([tokens for tokens, _ in held]), np.concatenate([starts[:-1] + b for (_, starts), b in zip(held, begin, strict=False)] + [begin[-1:]])

    for _, _, tokens, starts in tokens_of(col):
        if held and size + len(tokens) > SCORE_TOKENS:
            yield joined()
            held, size = [], 0
        held.append((tokens, starts))
        size += len(tokens)
    if held:
        yield joined()


def _save(path: str, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        target = f"{path}.{name}.npy"
        own = f"{target}.{uuid.uuid4().hex}.tmp.npy"
        np.save(own, values)
        os.replace(own, target)


def _map(path: str, name: str) -> np.ndarray:
    return np.load(f"{path}.{name}.npy", mmap_mode="r").view(np.ndarray)  # mapped still, with plain indexing


class Counts:
    """Counts in a byte each; larger ones stand in a short list of places and values."""

    def __init__(self, path: str, name: str):
        self.small, self.at, self.large = _map(path, name), *(_map(path, f"{name}-{x}") for x in ("at", "large"))

    @staticmethod
    def arrays(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(values >= 255)
        return {name: np.minimum(values, 255).astype(np.uint8), f"{name}-at": at, f"{name}-large": values[at].astype(np.int64)}

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        out = self.small[index].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large[np.searchsorted(self.at, index[big])]
        return out


class Ids:
    """Word ids in three bytes each, or four where the vocabulary is that large."""

    def __init__(self, path: str, name: str):
        raw = _map(path, name)
        self.short = raw.dtype == np.uint8
        self.raw = np.ndarray((len(raw) // 3,), "<u4", raw, 0, (3,)) if self.short else raw

    @staticmethod
    def arrays(name: str, values: np.ndarray, vocabulary: int) -> dict[str, np.ndarray]:
        wide = values.astype("<u4")
        # three bytes and a last one, so that each id can be read as four
        return {name: wide if vocabulary >= 1 << 24 else np.append(wide.view(np.uint8).reshape(-1, 4)[:, :3].reshape(-1), np.uint8(0))}

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        found = self.raw[index]
        return found & np.uint32(0xFFFFFF) if self.short else found


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """Place of each wanted value in its own ascending stretch of `values`, which are below `most`; -1 where it is not.

    Word ids are ranks of hashes, so they lie evenly and places are interpolated; each
    third step halves the stretch, whatever it holds.
    """
    out = np.full(len(wanted), -1)
    open_ = np.flatnonzero(low < high)
    low, high, wanted = low[open_], high[open_], wanted[open_].astype(np.int64)
    below, above = np.full(len(open_), -1), np.full(len(open_), most)
    step = 0
    while len(open_):
        if step % 3 == 2:
            middle = (low + high) >> 1
        else:
            middle = low + ((wanted - below) * (high - low)) // (above - below + 1)
        found = values[middle].astype(np.int64)
        hit = found == wanted
        out[open_[hit]] = middle[hit]
        less = found < wanted
        low, below = np.where(less, middle + 1, low), np.where(less, found, below)
        high, above = np.where(less, high, middle), np.where(less, above, found)
        on = np.flatnonzero((low < high) & ~hit)
        open_, low, high, wanted, below, above = (x[on] for x in (open_, low, high, wanted, below, above))
        step += 1
    return out


def _scattered(contexts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of a one-to-one hash of each context: 32 + 16 bits, or 32 + 32 for vocabularies of 2^24 ids or more."""
    if vocabulary >= (1 << 24) - 1:
        x = mix64(contexts)
        return (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)
    mask, half = np.uint64((1 << 48) - 1), np.uint64(24)
    x = ((contexts >> np.uint64(32)) << half) | (contexts & np.uint64(0xFFFFFF))
    for odd in (0x9E3779B97F4B, 0xC2B2AE3D27D5):
        x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
    x ^= x >> half
    return (x >> np.uint64(16)).astype(np.uint32), x.astype(np.uint16)


class Contexts:
    """Contexts sorted by their one-to-one hash."""

    def __init__(self, path: str, name: str):
        self.high, self.low = _map(path, name), _map(path, f"{name}-low")

    @staticmethod
    def arrays(name: str, contexts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The order they stand in, and their arrays."""
        high, low = _scattered(contexts, vocabulary)
        order = np.lexsort((low, high))
        return order, {name: high[order], f"{name}-low": low[order]}

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each hash of ascending ones; -1 where it is not."""
        out = np.full(len(high), -1)
        if not len(self.high):
            return out
        at = np.searchsorted(self.high, high)
        at[at == len(self.high)] = 0
        left = np.flatnonzero(self.high[at] == high)
        while len(left):
            place = at[left]
            hit = (self.high[place] == high[left]) & (self.low[place] == low[left])
            out[left[hit]] = place[hit]
            left = left[~hit & (place + 1 < len(self.high))]
            at[left] += 1
            left = left[self.high[at[left]] == high[left]]
        return out


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending uint64 values and their counts, delta-coded in byte planes."""
    delta = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [p for p in range(8) if planes[p].any()]
    low = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(values), len(used), *used], "<u4").tobytes()
    big = counts[counts >= 255].astype("<u8").tobytes()
    return zlib.compress(head + planes[used].tobytes() + low.tobytes() + big, 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n, k = np.frombuffer(raw, "<u4", 2)
    used = np.frombuffer(raw, "<u4", k, 8)
    at = 8 + 4 * int(k)
    planes = np.zeros((8, n), np.uint8)
    planes[used] = np.frombuffer(raw, np.uint8, int(n) * int(k), at).reshape(k, n)
    at += int(n) * int(k)
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, at + int(n)).astype(np.int64)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64), counts


def _merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return v[first], (np.add.reduceat(c, first) if len(v) else c)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _merged([v for v, _ in parts], [c for _, c in parts])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries counted 1, 2, 3 and 4 times.

    Each is held between 0.1 and its count: on very little text the estimate may
    be 0 or less, which would leave unseen words no probability.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2):
        return 0.5, 0.5, 0.5  # too little text to estimate from
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.1), float(k)) for k, d in ((1, d1), (2, d2), (3, d3)))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals that go with them."""

    folder: str
    bits: int
    base: tuple[int, ...]
    tokens: int
    vocabulary: int
    order: int = 3
    discounts: tuple[tuple[float, float, float], ...] = ()  # of words, pairs, ...
    contexts_total: int = 0
    spread: float = 1.0

    def file(self, kind: str, bucket: int) -> str:
        return f"{self.folder}/{kind}-{bucket}"


#: Buckets whose files a worker keeps open at once.
OPEN_BUCKETS = 1 << 12
_FORMS = {"count": Counts, "total": Counts, "once": Counts, "twice": Counts, "word": Ids, "follower": Ids, "context": Contexts, "lone": Contexts}


@lru_cache(maxsize=OPEN_BUCKETS)
def _opened_files(path: str, names: tuple[str, ...]) -> tuple | None:
    return tuple(_FORMS.get(n, _map)(path, n) for n in names) if os.path.exists(f"{path}.{names[0]}.npy") else None


def _stretches(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


def _order(values: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers from 0 up to `most`, counted out in digits of 16 bits."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        order = order[np.argsort((values >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs of equal values."""
    if not len(sorted_values):
        return
    cut = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])).tolist()
    for lo, hi in zip(cut, [*cut[1:], len(sorted_values)], strict=True):
        yield int(sorted_values[lo]), lo, hi


def word_ids(hashes: np.ndarray, model: Model) -> np.ndarray:
    """Ranks of ascending distinct hashes in the vocabulary; -1 where unknown."""
    out = np.full(len(hashes), -1, np.int64)
    for b, lo, hi in _runs(hashes >> np.uint64(64 - model.bits)):
        files = _opened_files(model.file("words", b), ("hash",))
        if files is not None:
            at = np.minimum(np.searchsorted(files[0], hashes[lo:hi]), len(files[0]) - 1)
            out[lo:hi] = np.where(files[0][at] == hashes[lo:hi], at + model.base[b], -1)
    return out


def _block_ids(tokens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their ids, position of each token among them)."""
    distinct, where = np.unique(tokens, return_inverse=True)
    return distinct, word_ids(distinct, model), where


def _contexts(ids: np.ndarray, starts: np.ndarray, begin: int, order: int) -> np.ndarray:
    """The context of each token in 64 bits; -1 where it has an unknown word."""
    one = np.empty_like(ids)
    one[1:] = ids[:-1]
    one[starts[:-1]] = begin
    if order == 2:
        return one
    two = np.empty_like(ids)
    two[1:] = one[:-1]
    two[starts[:-1]] = begin
    return np.where((one >= 0) & (two >= 0), (two << 32) | one, -1)


def bucket_of(contexts: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(contexts.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


WORDS = schema(bucket=INT, blob=BIN)


def _unigrams(train: DataFrame, bits: int, folder: str) -> tuple[tuple[int, ...], int, int]:
    """Write the words of each bucket; their first ids, and the numbers of tokens and words."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def send() -> pa.RecordBatch:
            v, c = _merged(values, counts)
            cut = np.searchsorted(v, edges).tolist() + [len(v)]
            parts = [(b, _packed(v[lo:hi], c[lo:hi])) for b, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=WORDS.names)

        for batch in batches:
            for _, _, tokens, _ in tokens_of(batch.column("text")):
                v, c = np.unique(tokens, return_counts=True)
                values.append(v)
                counts.append(c)
                held += len(v)
                if held > GATHER:
                    v, c = _merged(values, counts)
                    values, counts, held = [v], [c], len(v)
                    if held > GATHER // 2:
                        yield send()
                        values, counts, held = [], [], 0
        if values:
            yield send()

    done = schema(bucket=INT, words=LONG, tokens=LONG)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (h, n) in _merged_blobs(batches, _unpacked, _added):
            _save(f"{folder}/words-{bucket}", hash=h, **Counts.arrays("count", n))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(h)]), pa.array([int(n.sum())])], names=done.names)

    dealt = train.select("text").mapInArrow(count, WORDS).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    sizes = {r["bucket"]: (r["words"], r["tokens"]) for r in dealt.mapInArrow(save, done).collect()}  # a row per bucket
    words = [sizes.get(b, (0, 0))[0] for b in range(1 << bits)]
    base = tuple(int(x) for x in np.concatenate([[0], np.cumsum(words)[:-1]]))
    return base, sum(t for _, t in sizes.values()), sum(words)


#: Blobs by bucket; rows with a level hold that level's counts of counts instead.
BLOBS = schema(bucket=INT, blob=BIN, level=INT, n1=LONG, n2=LONG, n3=LONG, n4=LONG, more=LONG, entries=LONG)
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # contexts (uint64), words (uint32), counts, sorted by both


def _rows(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    none = pa.nulls(len(blobs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary()), none.cast(pa.int32()), *[none] * 6], names=BLOBS.names)


def _told(level: int, counts: np.ndarray) -> pa.RecordBatch:
    """Numbers of entries counted 1, 2, 3 and 4 times, 3 or more times, and all."""
    values = [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()), len(counts)]
    return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([level], pa.int32()), *(pa.array([v]) for v in values)], names=BLOBS.names)


def _combined(parts: list[Entries]) -> Entries:
    """Entries of several sorted or unsorted parts, equal ones added."""
    context, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(context):
        return context, word, count
    order = np.argsort(context, kind="stable")  # sorted parts are merged
    ranks = context[order]
    key = (np.cumsum(np.append(False, ranks[1:] != ranks[:-1]), dtype=np.uint64) << np.uint64(32)) | word[order]
    order = order[np.argsort(key, kind="stable")]  # in order but for contexts of several parts
    context, word, count = context[order], word[order], count[order]
    first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
    return context[first], word[first], np.add.reduceat(count, first)


def _numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers in byte planes; planes of nothing but zeros are left out."""
    wide = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [p for p in range(8) if wide[p].any()]
    return bytes([len(used), *used]) + wide[used].tobytes()


def _parsed(raw: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    used = list(raw[at + 1 : at + 1 + raw[at]])
    at += 1 + len(used)
    planes = np.zeros((8, n), np.uint8)
    planes[used] = np.frombuffer(raw, np.uint8, n * len(used), at).reshape(len(used), n)
    return np.ascontiguousarray(planes.T).view("<u8")[:, 0], at + n * len(used)


def _blob(entries: Entries) -> bytes:
    context, word, count = entries
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    heads = context[first]
    step = np.diff(word.astype(np.int64), prepend=0)
    step[first] = word[first]
    sizes = np.diff(np.append(first, len(word)))
    raw = np.array([len(heads), len(word)], "<u4").tobytes() + b"".join(map(_numbers, (np.diff(heads, prepend=np.uint64(0)), sizes, step, count)))
    return zlib.compress(raw, 1)


def _opened(blob: bytes) -> Entries:
    raw = memoryview(zlib.decompress(blob))
    n, m = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    heads, at = _parsed(raw, 8, n)
    sizes, at = _parsed(raw, at, n)
    step, at = _parsed(raw, at, m)
    count, _ = _parsed(raw, at, m)
    heads, sizes = np.cumsum(heads, dtype=np.uint64), sizes.astype(np.int64)
    total = np.cumsum(step.astype(np.int64))
    before = (np.cumsum(sizes) - sizes).astype(np.int64)
    word = total - np.repeat(total[before] - step[before].astype(np.int64), sizes)
    return np.repeat(heads, sizes), word.astype(np.uint32), count.astype(np.int64)


def _by_bucket(entries: Entries, bits: int) -> pa.RecordBatch | None:
    context, word, count = entries
    if not len(context):
        return None
    bucket = bucket_of(context, bits)
    order = _order(bucket, 1 << bits)
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
    parts = [(int(bucket[lo]), _blob(tuple(x[order[lo:hi]] for x in entries))) for lo, hi in zip(cut, cut[1:], strict=False)]
    return _rows(parts)


def _merged_blobs(batches: Iterator[pa.RecordBatch], opened: Callable, combined: Callable) -> Iterator[pa.RecordBatch | tuple[int, tuple]]:
    """(bucket, what its blobs combine to) of rows sorted by bucket, merged as they come; rows with a level pass."""
    bucket, parts, size = None, [], 0
    for batch in batches:
        if "level" in batch.schema.names:
            told = batch.filter(pc.is_valid(batch.column("level")))
            if len(told):
                yield told
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if not blob.is_valid:
                continue
            if b != bucket:
                if bucket is not None:
                    yield bucket, combined(parts)
                bucket, parts, size = b, [], 0
            parts.append(opened(blob.as_py()))
            size += len(parts[-1][0])
            if size > 2 * len(parts[0][0]) + GATHER:
                parts = [combined(parts)]
                size = len(parts[0][0])
    if bucket is not None:
        yield bucket, combined(parts)


def _gathered(train: DataFrame, model: Model) -> DataFrame:
    """Counts of the highest order, by bucket, combined within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, tokens, starts in tokens_of(batch.column("text")):
                _, ids, where = _block_ids(tokens, model)
                w = ids[where]
                heads, at = np.unique(_contexts(w, starts, model.vocabulary, model.order).astype(np.uint64), return_inverse=True)
                key, count = np.unique((at.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_counts=True)
                parts.append((heads[(key >> np.uint64(32)).astype(np.int64)], (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), count))
                held += len(key)
                if held > GATHER:
                    yield _by_bucket(_combined(parts), model.bits)
                    parts, held = [], 0
        if parts and (rows := _by_bucket(_combined(parts), model.bits)) is not None:
            yield rows

    return train.select("text").mapInArrow(run, BLOBS)


def _stored(blobs: DataFrame, model: Model, level: int) -> DataFrame:
    """Write the arrays of a level; rows are blobs of the level below and counts of counts."""
    base, begin = np.array(model.base, np.uint64), np.uint64(model.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _merged_blobs(batches, _opened, _combined):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            bucket, (context, word, count) = found
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            single = (sizes == 1) & (count[first] == 1)
            lone, heads = first[single], first[~single]
            own, arrays = Contexts.arrays("lone", context[lone], model.vocabulary)
            _save(model.file(level, bucket), **arrays, **Ids.arrays("follower", word[lone][own], model.vocabulary))
            own, arrays = Contexts.arrays("context", context[heads], model.vocabulary)
            heads, sizes = heads[own], sizes[~single][own]
            start = np.cumsum(np.append(0, sizes))
            at = np.arange(start[-1]) + np.repeat(heads - start[:-1], sizes)
            own_word, own_count = word[at], count[at]
            sums = [np.add.reduceat(x, start[:-1]) if len(heads) else np.zeros(0, np.int64) for x in (own_count, (own_count == 1).astype(np.int64), (own_count == 2).astype(np.int64))]
            named = {k: v for name, x in zip(("total", "once", "twice", "count"), (*sums, own_count), strict=True) for k, v in Counts.arrays(name, x).items()}
            _save(model.file(level, bucket), **arrays, start=start.astype(np.uint32 if len(own_word) < 1 << 32 else np.int64), **Ids.arrays("word", own_word, model.vocabulary), **named)
            yield _told(level, count)
            if level > 2:
                shorter = context & np.uint64(0xFFFFFFFF)
                rows = _by_bucket(_combined([(shorter, word, np.where(shorter == begin, count, 1))]), model.bits)
                if rows is not None:
                    yield rows
            else:
                values, times = np.unique(word, return_counts=True)
                cut = np.searchsorted(values, base).tolist() + [len(values)]
                parts = [(b, _packed(values[lo:hi].astype(np.uint64), times[lo:hi])) for b, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if hi > lo]
                yield _rows(parts)

    return _dealt(blobs, model).mapInArrow(run, BLOBS)


def _followed(blobs: DataFrame, model: Model) -> DataFrame:
    """Write how many different words each word follows; rows are counts of counts of all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _merged_blobs(batches, _unpacked, _added):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            bucket, (values, counts) = found
            last = model.base[bucket + 1] if bucket + 1 < len(model.base) else model.vocabulary
            after = np.zeros(last - model.base[bucket], np.int64)
            after[values.astype(np.int64) - model.base[bucket]] = counts
            _save(model.file("after", bucket), **Counts.arrays("count", after))
            yield _told(1, counts)

    return _dealt(blobs, model).mapInArrow(run, BLOBS)


def _dealt(blobs: DataFrame, model: Model) -> DataFrame:
    return blobs.repartition(1 << model.bits, "bucket").sortWithinPartitions("bucket")


def train_model(train: DataFrame, folder_url: str, order: int = 3) -> Model:
    """Count the texts of `train` (column text) and write the model into a mounted shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3: a context is at most two 32-bit ids")
    spark = train.sparkSession
    ship(spark)
    folder = posix_path(folder_url)
    os.makedirs(folder, exist_ok=True)
    bits = buckets_for(partitions_for(train)).bit_length() - 1
    base, tokens, words = _unigrams(train, bits, folder)
    if words >= (1 << 32) - 1:
        raise ValueError("the vocabulary has 2^32 words or more")
    model = Model(folder, bits, base, tokens, words, order)
    blobs = _gathered(train, model)
    for level in range(order, 1, -1):
        blobs = _stored(blobs, model, level)
    names = ("n1", "n2", "n3", "n4", "more", "entries")
    rows = _followed(blobs, model).where("level IS NOT NULL").groupBy("level").agg(*(F.sum(n).alias(n) for n in names)).collect()  # a row per order
    told = {r["level"]: [int(r[n]) for n in names] for r in rows}
    found = tuple(discounts(told[k][:4]) if k in told else (0.5, 0.5, 0.5) for k in range(1, order + 1))
    pairs = told[2][5] if 2 in told else 0
    spread = (found[0][0] * told[1][0] + found[0][1] * told[1][1] + found[0][2] * told[1][4]) / pairs if pairs else 1.0
    return Model(folder, bits, base, tokens, words, order, found, pairs, spread)


class Scorer:
    """Log probabilities from the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model, self.base = model, np.array(model.base, np.int64)

    def _take(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Per-word counts for ascending ids; zero where there is none."""
        out = np.zeros(len(ids), np.int64)
        for b, lo, hi in _runs(np.searchsorted(self.base, ids, side="right") - 1):
            files = _opened_files(self.model.file(kind, b), ("count",))
            if files is not None:
                out[lo:hi] = files[0][ids[lo:hi] - self.base[b]]
        return out

    def _level(self, level: int, contexts: np.ndarray, at: np.ndarray, ids: np.ndarray, where: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of words after contexts of one order, from those of the order below; which pairs there are, and each token's.

        A token is word `ids[where]` after `contexts[at]`, which is -1 where it has an unknown word.  Each context is looked up once,
        and each word after it once: it has a gain of its own and the weight of the order below.
        """
        d = np.array([0.0, *self.model.discounts[level - 1]])
        key = at * len(ids) + where
        order = _order(key, len(contexts) * len(ids))
        key = key[order]
        fresh = np.append(True, key[1:] != key[:-1])
        own = np.empty(len(key), np.int64)
        own[order] = np.cumsum(fresh) - 1
        head, last = np.divmod(key[fresh], len(ids))
        follows = ids[last]
        begin = np.searchsorted(head, np.arange(len(contexts) + 1))
        gain, rest = np.zeros(len(head)), np.ones(len(head))
        heads = np.flatnonzero(contexts >= 0)
        bucket = bucket_of(contexts[heads], self.model.bits)
        order = _order(bucket, 1 << self.model.bits)
        heads, bucket = heads[order], bucket[order]
        for b, lo, hi in _runs(bucket):
            files = _opened_files(self.model.file(level, b), ("context", "start", "total", "once", "twice", "word", "count", "lone", "follower"))
            if files is None:
                continue
            listed, start, total, once, twice, words, counts, lone, follower = files
            mine = heads[lo:hi]
            high, low = _scattered(contexts[mine].astype(np.uint64), self.model.vocabulary)
            near = np.argsort(high)  # neighbours are looked up one after another
            mine, high, low = mine[near], high[near], low[near]
            at = lone.find(high, low)
            seen = np.flatnonzero(at >= 0)
            first, sizes = begin[mine[seen]], begin[mine[seen] + 1] - begin[mine[seen]]
            rows = _stretches(first, sizes)
            gain[rows] = np.where(np.repeat(follower[at[seen]], sizes) == follows[rows], max(1 - d[1], 0), 0.0)
            rest[rows] = d[1]
            left = np.flatnonzero(at < 0)
            at = listed.find(high[left], low[left])
            seen = left[at >= 0]
            at = at[at >= 0]
            if not len(at):
                continue
            low, high = start[at].astype(np.int64), start[at + 1].astype(np.int64)
            one, two, whole = once[at], twice[at], total[at]
            first, sizes = begin[mine[seen]], begin[mine[seen] + 1] - begin[mine[seen]]
            rows = _stretches(first, sizes)
            rest[rows] = np.repeat((d[1] * one + d[2] * two + d[3] * (high - low - one - two)) / whole, sizes)
            place = _within(words, np.repeat(low, sizes), np.repeat(high, sizes), follows[rows], self.model.vocabulary)
            c = np.where(place >= 0, counts[np.maximum(place, 0)], 0)
            gain[rows] = np.maximum(c - d[np.minimum(c, 3)], 0) / np.repeat(whole, sizes)
        return gain[own] + rest[own] * lower, head, last, own

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base score, model score, known tokens) of each row of a block."""
        m = self.model
        _, ids, where = _block_ids(tokens, m)
        known = ids >= 0
        by_id = np.argsort(ids[known])
        counts, after = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        here = np.flatnonzero(known)[by_id]
        counts[here], after[here] = self._take("words", ids[here]), self._take("after", ids[here])
        base = np.log10((counts + 1) / (m.tokens + m.vocabulary + 1))
        e = np.array([0.0, *(m.discounts[0] if m.discounts else (0.5, 0.5, 0.5))])
        lower = np.maximum(after - e[np.minimum(after, 3)], 0) / max(m.contexts_total, 1) + m.spread / (m.vocabulary + 1)
        p, contexts, last = lower[where], np.append(ids, m.vocabulary), where  # the last one begins a text
        for level in range(2, m.order + 1):
            if level == 3:
                contexts = np.where((contexts[head] >= 0) & (ids[word] >= 0), (contexts[head] << 32) | ids[word], -1)
                contexts = np.append(contexts, (m.vocabulary << 32) | m.vocabulary)
            at = np.append(0, last[:-1])
            at[starts[:-1]] = len(contexts) - 1
            p, head, word, last = self._level(level, contexts, at, ids, where, p)
        add = lambda x: np.add.reduceat(x, starts[:-1])
        return add(base[where]), add(np.log10(p)), add(known[where].astype(np.int64))


@lru_cache(maxsize=1)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


SCORED = schema(doc_id=LONG, held_out=BOOL, n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=DBL, score=DBL, perplexity=DBL)


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", model_dir: str | None = None, order: int = 3) -> DataFrame:
    """Log10 probability and perplexity of every row under a model of the rows where `train` holds.

    `model_dir` is a folder that driver and executors mount at one path;
    the session's shared folder where it is not given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("_train"))
    model = train_model(rows.where("_train").select("text"), model_dir or scratch_path(spark, "lm"), order)
    shared = spark.sparkContext.broadcast(model)  # paths and a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _scorer(model)
        for batch in batches:
            found = [(np.diff(starts), *scorer.score(tokens, starts)) for tokens, starts in joined_tokens(batch.column("text"))]
            if not found:
                continue
            n, base, score, known = (np.concatenate(x) for x in zip(*found, strict=True))
            held = ~batch.column("_train").to_numpy(zero_copy_only=False).astype(bool)
            arrays = [batch.column("doc_id"), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
            yield pa.RecordBatch.from_arrays(arrays, names=SCORED.names)

    return rows.mapInArrow(run, SCORED)


def training_fold(id_col: str = "doc_id", folds: int = 7, held_out: int = 2) -> Column:
    """True for rows outside the held-out fold of crc32(id as text)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out, F.lit(True))
