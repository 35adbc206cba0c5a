"""Alignment of two tokenizers' tokens by their bytes.

Tokenizer A is a byte-level BPE file of the `tokenizers` library, B a SentencePiece model;
A encodes a space and the text, B the text, to which it adds the space itself.  Every
byte of that string has a label: none, end of an A token, end of a B token, or both.  A regular
expression scans the labels and takes the spans up to each both-label; the labels counted
in a span are the numbers of tokens of one group.  Every labelled byte closes one stretch that
lies in one A and one B token, so the labelled bytes in order are the links.

Neither tokenizer joins anything across a single space between two visible characters (the
files are tested for that, else texts stay whole), so a text's ids are those of its runs between
such spaces; a worker keeps the ids of the runs it has met by their 64-bit hashes, up to
CACHE_RUNS of them.  Texts are encoded and labelled in pieces of at most PIECE_BYTES, which bound a worker's
memory; a longer text is cut where runs begin (a run is whole), and its pieces' counts, pairs and digest are put together.
Texts of at most BLOCK_BYTES (or one longer text) are a block, one row of a written table: per document the digest of its groups
and its distinct linked id pairs as numbers into the block's own list of pairs.  Row groups of that table
hold a few blocks, so neither its writer nor its readers hold all blocks of a task.  Only
these lists are shuffled: pairs are counted over all blocks (numbers of documents, partial sums
first), each block's pairs fetch their counts in a shuffled join, which adaptive execution
splits at hot pairs, and come back to their block.  What is broadcast is one row per id of A.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the
text (normalised characters, U+2581), have no tokens: zeros and an empty digest; the strings
of special tokens are plain text; rows that repeat count as documents of their own; null ids
stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm.bytekernel import byte_hashes, row_blocks, text_bytes
from memlattice.llm.shared import LONG, STR, narrow, schema, ship, written

#: Bytes of text that are one block, bytes that are aligned at once, runs that are encoded at once, and runs that a worker keeps.
BLOCK_BYTES, PIECE_BYTES, AT_ONCE, CACHE_RUNS = 4 << 20, 1 << 19, 4096, 400_000
#: Bytes of a row group of blocks; Parquet's writer looks at them after every row.
GROUP_BYTES = 16 << 20
#: Labels of a byte: none, A-end, B-end, both.
LABELS = np.frombuffer(b".ABX", np.uint8)
_GROUP = re.compile(rb"[.AB]*X")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Spelled(NamedTuple):
    """The bytes of every id, one after another, and where each id's begin."""

    data: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Spelled:
        return cls(np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids + 1] - self.first[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes(ids)
        ends = np.cumsum(n)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - (ends - n), n)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligned(NamedTuple):
    """Tokens, groups and links of a block of texts; the `at_` arrays are where each text's begin, and the total."""

    ids_a: np.ndarray
    at_a: np.ndarray
    ids_b: np.ndarray
    at_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    at_groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    at_links: np.ndarray


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _spaced(texts: list[str | None]) -> list[bytes]:
    return [b" " + t.encode() if t else b"" for t in texts]


class Ids:
    """Id lists that grow at the end, found by number."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def insert(self, at: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, 2 * len(flat)), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.first = np.insert(self.first, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(flat)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each)."""
        n = self.count[numbers]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[numbers] - (ends - n), n)], n


def fits(spelled: Spelled, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each list of ids spells its run; `raw` has the runs' bytes one after another."""
    bytes_at = _starts(spelled.sizes(ids))[_starts(count)]
    same = np.diff(bytes_at) == size
    wrong = _starts(spelled.joined(ids[np.repeat(same, count)]) != raw[np.repeat(same, size)])
    same[same] = np.diff(wrong[_starts(size[same])]) == 0
    return same


def _splits_at_spaces(path_a: str, pieces: list[str]) -> bool:
    """Whether both files encode what follows a single space between visible characters by itself."""
    with open(path_a, encoding="utf-8") as file:
        parts = json.load(file)
    splits = parts.get("pre_tokenizer") or {}
    plain = not parts.get("normalizer") and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
    return bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces)


#: Visible ASCII, and the first byte of U+00C0 to U+00FF: characters that are no space and combine with none.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LATIN = 0xC3


def run_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs of texts begin: at every text, and at every single space between two visible characters."""
    begins = np.zeros(len(raw), bool)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 1) & (at < len(raw) - 1)]
    before = _VISIBLE[raw[at - 1]] | ((raw[at - 1] & 0xC0 == 0x80) & (raw[at - 2] == _LATIN))
    after = _VISIBLE[raw[at + 1]] | (raw[at + 1] == _LATIN)
    begins[at[before & after]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Aligner:
    """Encodes with both files and aligns."""

    def __init__(self, path_a: str, path_b: str, cache_runs: int = CACHE_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.spelled_a = Spelled.of(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelled_b = Spelled.of([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.splits, self.cache_runs = _splits_at_spaces(path_a, pieces), cache_runs
        self._forget()
        size = max(len(self.spelled_a.first), len(self.spelled_b.first)) - 1
        decimal = np.array([str(i) for i in range(size)], "S")
        self.digits, self.n_digits = decimal.view(np.uint8).reshape(size, -1), np.char.str_len(decimal).astype(np.int64)

    def _forget(self) -> None:
        self.keys, self.good = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.kept_a, self.kept_b = Ids(), Ids()

    def _learn(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """Encode new runs, given with their ascending hashes; what either file does not spell again has no ids."""
        parts: list[list[tuple[np.ndarray, ...]]] = [[], []]
        for lo in range(0, len(runs), AT_ONCE):
            part = runs[lo : lo + AT_ONCE]
            some = [r.decode() for r in part]
            raw, size = np.frombuffer(b"".join(part), np.uint8), np.array([len(r) for r in part], np.int64)
            lists_a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            lists_b = self.b.encode([r[1:] for r in some], num_threads=1)  # B adds the space that every run begins with
            for done, lists, spelled in zip(parts, (lists_a, lists_b), (self.spelled_a, self.spelled_b), strict=True):
                count = np.array([len(x) for x in lists], np.int64)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum()))
                done.append((flat, count, fits(spelled, flat, count, raw, size)))
        at, found = np.searchsorted(self.keys, hashes), [[np.concatenate(x) for x in zip(*done, strict=True)] for done in parts]
        good = found[0][2] & found[1][2]
        for kept, (flat, count, _) in zip((self.kept_a, self.kept_b), found, strict=True):
            kept.insert(at, flat[np.repeat(good, count)], np.where(good, count, 0))
        self.keys, self.good = np.insert(self.keys, at, hashes), np.insert(self.good, at, good)

    def _runs(self, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each run among those kept, where each text's runs begin and the total)."""
        data, offsets = b"".join(whole), _starts(np.array([len(w) for w in whole], np.int64))
        raw = np.frombuffer(data, np.uint8)
        begins = run_starts(raw, offsets) if self.splits else offsets[:-1][np.diff(offsets) > 0]
        if not len(begins):
            return begins, np.zeros(len(offsets), np.int64)
        size = np.diff(np.append(begins, len(raw)))
        distinct, where, own = np.unique(byte_hashes(raw, begins, size), return_index=True, return_inverse=True)
        if len(self.keys) > self.cache_runs:
            self._forget()
        fresh = np.ones(len(distinct), bool)
        at = np.searchsorted(self.keys, distinct)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != distinct[inside]
        if fresh.any():
            new = where[fresh]
            self._learn(distinct[fresh], [data[x : x + n] for x, n in zip(begins[new].tolist(), size[new].tolist(), strict=True)])
        return np.searchsorted(self.keys, distinct)[own], np.searchsorted(begins, offsets)

    def align(self, texts: list[str | None]) -> Aligned:
        """All tokens, groups and links of some texts."""
        return self.align_bytes(_spaced(texts))

    def align_bytes(self, whole: list[bytes]) -> Aligned:
        """The same, of texts or their pieces as bytes that begin with a space."""
        run, at = self._runs(whole)
        spoilt = _starts(~self.good[run])[at]
        run_text = np.repeat(np.arange(len(whole)), np.diff(at))
        use = (np.diff(spoilt) == 0)[run_text]  # a text has all its tokens or none
        run, run_text = run[use], run_text[use]
        (ids_a, n_a), (ids_b, n_b) = self.kept_a.take(run), self.kept_b.take(run)
        at_a, at_b = (_starts(np.bincount(run_text, n, len(whole)).astype(np.int64)) for n in (n_a, n_b))
        ends_a, ends_b = np.cumsum(self.spelled_a.sizes(ids_a)), np.cumsum(self.spelled_b.sizes(ids_b))
        label = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
        label[ends_a - 1] = 1
        label[ends_b - 1] |= 2
        spans = np.cumsum(np.fromiter(map(len, _GROUP.findall(LABELS[label].tobytes())), np.int64))  # groups leave no gap
        marked = np.flatnonzero(label)
        kind = label[marked]
        seen_a, seen_b = _starts(kind & 1), _starts(kind >> 1)
        closes = np.searchsorted(marked, spans)  # labelled bytes up to and with a group's last one
        group_a, group_b = np.diff(np.append(0, seen_a[closes])), np.diff(np.append(0, seen_b[closes]))
        bytes_at = np.append(0, ends_a)[at_a]
        return Aligned(
            ids_a, at_a, ids_b, at_b, group_a, group_b, np.searchsorted(spans, bytes_at, side="right"),
            ids_a[seen_a[:-1]], ids_b[seen_b[:-1]], np.searchsorted(marked, bytes_at),
        )

    def group_bytes(self, x: Aligned) -> tuple[bytes, list[int]]:
        """(`a1,a2|b1;a3|b2,b3;` of all texts one after another, where each text's begins and the total)."""
        before_a, before_b = _starts(x.group_a), _starts(x.group_b)
        n = len(x.ids_a) + len(x.ids_b)
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        place_a = np.arange(len(x.ids_a)) + np.repeat(before_b[:-1], x.group_a)
        place_b = np.arange(len(x.ids_b)) + np.repeat(before_a[1:], x.group_b)
        ids[place_a], ids[place_b] = x.ids_a, x.ids_b
        mark[place_a[before_a[1:] - 1]] = ord("|")
        mark[place_b[before_b[1:] - 1]] = ord(";")
        size = self.n_digits[ids]
        at = _starts(size + 1)
        out = np.zeros(int(at[-1]), np.uint8)
        for k in range(self.digits.shape[1]):
            some = np.flatnonzero(size > k)
            out[at[some] + k] = self.digits[ids[some], k]
        out[at[:-1] + size] = mark
        return out.tobytes(), at[x.at_a + x.at_b].tolist()

    def group_digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        data, cuts = self.group_bytes(x)
        return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def cut(self, whole: bytes) -> Iterator[bytes]:
        """A long text in pieces that begin where runs do, of at most PIECE_BYTES each or one longer run."""
        lo, reach = 0, PIECE_BYTES
        while self.splits and lo + PIECE_BYTES < len(whole):
            raw = np.frombuffer(whole, np.uint8, min(reach + 2, len(whole) - lo), lo)
            begins = run_starts(raw, np.array([0, len(raw)]))
            if len(begins) > 1:
                n = int(begins[begins <= PIECE_BYTES][-1]) or int(begins[1])
                yield whole[lo : lo + n]
                lo, reach = lo + n, PIECE_BYTES
            elif lo + reach < len(whole):  # no run begins so far
                reach *= 2
            else:
                break
        yield whole[lo:]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's pair of tokenizers; it lives as long as the worker."""
    return Aligner(path_a, path_b)


def _blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list[str | None]]]:
    texts = batch.column(1)
    _, offsets = text_bytes(texts)
    for lo, hi in row_blocks(offsets, limit):
        yield batch.column(0)[lo:hi], texts[lo:hi].to_pylist()


_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(LONG)
GROUPS = schema(doc_id=LONG, ids_a=_INTS, ids_b=_INTS, group_a=_INTS, group_b=_INTS)
BLOCKS = schema(
    block=LONG, doc_id=_LONGS, n_a=_LONGS, n_b=_LONGS, n_groups=_LONGS, n_links=_LONGS, groups_sha256=T.ArrayType(STR),
    pairs=_LONGS, holders=_LONGS, at=_LONGS, pair=_INTS, times=_INTS,
)
RESULT = schema(doc_id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, n_best=LONG, count_sum=LONG, groups_sha256=STR)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def token_groups(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids_a, ids_b, group_a, group_b): both encodings and the numbers of their tokens in each group."""
    path_a, path_b = files or default_files()
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _blocks(batch, PIECE_BYTES):
                x = aligner(path_a, path_b).align(texts)
                columns = [_lists(x.ids_a, x.at_a), _lists(x.ids_b, x.at_b), _lists(x.group_a, x.at_groups), _lists(x.group_b, x.at_groups)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=GROUPS.names)

    return narrow(docs).mapInArrow(work, GROUPS)


def _text_pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair of ids as one number, how often it links) of all distinct pairs of every text, in order."""
    pairs, own = np.unique(x.link_a.astype(np.int64) << 32 | x.link_b.astype(np.int64), return_inverse=True)
    text = np.repeat(np.arange(len(x.at_links) - 1), np.diff(x.at_links))
    each, times = np.unique(text * max(len(pairs), 1) + own, return_counts=True)
    held, pair = np.divmod(each, max(len(pairs), 1))
    return held, pairs[pair], times


def _long_text(tools: Aligner, whole: bytes) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """(its numbers of tokens, groups and links, digest, distinct pairs, how often each links) of a text in pieces."""
    sizes, digest, pairs, times, mark = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    for piece in tools.cut(whole):
        x = tools.align_bytes([piece])
        if not len(x.ids_a):  # a text has all its tokens or none
            return np.zeros(4, np.int64), "", pairs[:0], times[:0]
        sizes += [len(x.ids_a), len(x.ids_b), len(x.group_a), len(x.link_a)]
        digest.update(mark + tools.group_bytes(x)[0][:-1])
        _, more, again = _text_pairs(x)
        pairs, own = np.unique(np.concatenate([pairs, more]), return_inverse=True)
        times, mark = np.bincount(own, np.concatenate([times, again]), len(pairs)).astype(np.int64), b";"
    return sizes, digest.hexdigest(), pairs, times


def _block_row(tools: Aligner, number: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """The row of a block, whose texts are aligned piece by piece."""
    whole = _spaced(texts)
    sizes, digests, held, keys, times = [], [], [], [], []
    for lo, hi in row_blocks(_starts(np.array([len(w) for w in whole], np.int64)), PIECE_BYTES):
        if len(whole[lo]) > PIECE_BYTES:
            size, digest, pair, often = _long_text(tools, whole[lo])
            size, digest, text = size[:, None], [digest], np.zeros(len(pair), np.int64)
        else:
            x = tools.align_bytes(whole[lo:hi])
            size, digest = np.diff([x.at_a, x.at_b, x.at_groups, x.at_links]), tools.group_digests(x)
            text, pair, often = _text_pairs(x)
        for found, some in zip((sizes, held, keys, times), (size, text + lo, pair, often), strict=True):
            found.append(some)
        digests += digest
    pairs, pair = np.unique(np.concatenate(keys), return_inverse=True)
    at = np.searchsorted(np.concatenate(held), np.arange(len(texts) + 1))
    arrays = [
        ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids, *np.concatenate(sizes, axis=1), digests,
        pairs, np.bincount(pair, minlength=len(pairs)), at, pair, np.concatenate(times),
    ]
    columns = [pa.array([number], pa.int64())]
    for values, field in zip(arrays, BLOCKS.fields[1:], strict=True):
        kind = pa.string() if field.dataType == T.ArrayType(STR) else pa.int32() if field.dataType == _INTS else pa.int64()
        flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind)))
    return pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)


def aligned_blocks(docs: DataFrame, files: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block; `pair` and `times` are the distinct pairs of its texts and how often they link, from `at` on."""
    path_a, path_b = files or default_files()
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _blocks(batch, block_bytes):
                yield _block_row(aligner(path_a, path_b), number, ids, texts)
                number += 1

    return narrow(docs).mapInArrow(work, BLOCKS)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, holders) of every block's list, and (pair, count, best): documents that hold a pair linked."""
    listed = blocks.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("_p")).select("block", F.col("_p.pairs").alias("pair"), F.col("_p.holders").alias("holders"))
    counts = listed.groupBy("pair").agg(F.sum("holders").alias("count"))
    first = F.shiftright("pair", 32).alias("_a")
    highest = counts.groupBy(first).agg(F.max("count").alias("_most"))  # one row per id of A
    known = counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("_a"))
    return listed, known.select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align_documents(docs: DataFrame, files: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens, groups, links, links of highest count, the sum of their counts, and the groups' digest."""
    groups = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1"}
    blocks = written(aligned_blocks(docs, files, block_bytes), "aligned", compression="zstd", **groups)
    listed, counts = pair_counts(blocks.select("block", "pairs", "holders"))
    counts = written(counts, "pair-counts")
    looked = listed.select(F.col("block").alias("home"), "pair").join(counts, "pair")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        flat = {name: left[name].combine_chunks().flatten() for name in left.column_names if name != "block"}
        at, pair, times = (flat[name].to_numpy(zero_copy_only=False) for name in ("at", "pair", "times"))
        sums = [np.diff(_starts(values[pair] * times)[at]) for values in (best, count)]
        plain = [flat[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*plain, *[pa.array(s, pa.int64()) for s in sums], flat["groups_sha256"]], names=RESULT.names)

    rest = blocks.drop("pairs", "holders")
    return rest.groupBy("block").cogroup(looked.groupBy("home")).applyInArrow(gather, RESULT)
