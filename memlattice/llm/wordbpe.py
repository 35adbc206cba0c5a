"""Exact word-cached encoding with a public Hugging Face `tokenizers` file.

The word-level BPE file lower-cases and never joins characters across white space,
so a text's ids are the ids of its space-separated runs one after another.  A batch is
split and hashed in a few array passes; each worker keeps the ids of the runs
it has met, as arrays sorted by the runs' 64-bit hashes, and only new runs go to
the library.  The table is bounded: when it is full it starts anew.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa

from memlattice.llm.bytekernel import text_bytes, word_spans

#: Runs whose ids a worker keeps, about 40 bytes each.
CACHE_RUNS = 750_000
#: Marks that may close a run: ASCII punctuation but the apostrophe, which begins contractions.
_MARKS = "".join(c for c in string.punctuation if c != "'")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Encodes columns of texts to flat uint16/uint32 ids."""

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.cache_runs = cache_runs
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    @staticmethod
    def _pieces(run: str) -> int:
        """Parts that the file's own split makes of a run, each closed by one word end; 0 where that is not plain."""
        bare = run.rstrip(_MARKS)
        if bare and not (bare.isalpha() and max(bare) <= "\u00ff"):
            return 0
        return bool(bare) + (len(bare) < len(run))

    def _encoded(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of new runs; plain ones are encoded side by side and cut at their word ends."""
        out: list[np.ndarray | None] = [None] * len(runs)
        parts = [self._pieces(r) for r in runs]
        plain = [i for i, n in enumerate(parts) if n]
        for lo in range(0, len(plain), 512):
            some = plain[lo : lo + 512]
            text = " ".join([runs[i] for i in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            closes = np.cumsum([parts[i] for i in some])
            if len(ends) == closes[-1]:
                cut = [0, *ends[closes - 1].tolist()]
                for i, a, b in zip(some, cut, cut[1:], strict=False):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([runs[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.dtype)
        return out

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Add new runs, given with their ascending hashes."""
        found = self._encoded(runs)
        count = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, 2 * len(flat)), self.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(flat)

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the total); null and empty texts have none."""
        raw, offsets = text_bytes(col)
        hashes, starts, lens, rows = word_spans(raw, offsets)
        if not len(hashes):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        distinct, where, own = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.cache_runs:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != distinct[inside]
        if fresh.any():
            data = raw.tobytes()
            spans = zip(starts[where[fresh]].tolist(), lens[where[fresh]].tolist(), strict=True)
            self._learn(distinct[fresh], [data[a : a + n].decode() for a, n in spans])
            at = np.searchsorted(self.keys, distinct)
        first, count = self.first[at][own], self.count[at][own]
        ends = np.cumsum(count)
        index = np.arange(int(ends[-1])) + np.repeat(first - (ends - count), count)
        return self.ids[index], np.concatenate([[0], ends])[rows]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """One id array per text."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """The worker's encoder of a vocabulary file; it lives as long as the worker."""
    return WordBpe(path)
