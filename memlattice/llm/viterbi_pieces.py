"""SentencePiece encoding and decoding by streaming Viterbi over a public piece file.

The best segmentation has the highest sum of piece scores.  A path's score at a
position depends on scores of the last `longest` positions only, the longest
piece's length, and as soon as the backpointer paths of all of them meet in one
boundary, everything before it is settled: its ids are committed.  Characters that no
piece covers fall back to byte pieces at a fixed cost below the lowest score.

Two forms give the same ids.  `StreamingViterbi` takes one text's characters as they
come, keeps that window and traces paths back until they meet.  `LaneViterbi` encodes
whole columns: a trie walk over all positions at once finds every piece at every place of a
block of characters.  The block is cut into lanes of `LANE` characters or more that begin where
no piece spans, and lanes advance side by side, one position a step, each with a ring of
the last `longest` scores.  Every open path carries the boundary at which it crossed the lane's
last mark; once all open paths of a lane carry the same one they have met there, so
the lane commits its ids up to it and sets the next mark.  What is not settled at a block's end
is carried over to the next; a stretch beyond `LONGEST_LANE` without a place to
begin a lane goes through `StreamingViterbi`.

Decoding joins the pieces' bytes and turns word marks into spaces; a text
comes back exactly unless it has the word mark (U+2581) itself.

Defined results: a null or empty text has no ids and decodes to the empty text;
rows that repeat are encoded each; an empty table gives no rows; other columns are
ignored; text length is bounded by memory for the text alone.  Sums of scores are
taken from the beginning of a lane or a text on; whole-number scores, as of this file, add exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlattice.llm.packing import text_slices
from memlattice.llm.shared import BOOL, LONG, STR, narrow, schema, ship

MARK = "▁"
#: Characters matched at once, those of a lane, and the longest stretch that is worked on side by side with others.
BLOCK_CHARS, LANE, LONGEST_LANE = 1 << 18, 128, 512
#: Cost of an uncovered character below the lowest score.
FALLBACK = 10.0


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, scores and byte pieces of a file, as a trie of characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.trie: dict = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.longest, lowest = 1, 0.0
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(text.replace(MARK, " ").encode())
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = (sp.get_score(i), i)
                self.longest = max(self.longest, len(text))
                lowest = min(lowest, sp.get_score(i))
        self.fallback = lowest - FALLBACK


class StreamingViterbi:
    """Feed characters, take committed ids; `finish` gives the rest."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pending = ""  # characters from `base` on
        self.base = 0
        self.end = 0  # positions whose best path is final
        self.score = {0: 0.0}
        self.back: dict[int, tuple[int, int | None]] = {}

    def feed(self, chars: str) -> Iterator[int]:
        self.pending += chars
        last = self.base + len(self.pending) - self.pieces.longest
        while self.end <= last:
            stop = min(last + 1, self.end + 4 * self.pieces.longest)
            self._forward(stop)
            yield from self._commit()

    def finish(self) -> Iterator[int]:
        self._forward(self.base + len(self.pending))
        yield from self._emit(self.base + len(self.pending))

    def _forward(self, stop: int) -> None:
        """Extend paths from all positions before `stop`."""
        score, back, text, base = self.score, self.back, self.pending, self.base
        size = len(text)
        for at in range(self.end, stop):
            here, node = score[at], self.pieces.trie
            best = here + self.pieces.fallback
            if best > score.get(at + 1, -np.inf):
                score[at + 1], back[at + 1] = best, (at, None)
            k = at - base
            while k < size:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                found = node.get("")
                if found is not None:
                    best, to = here + found[0], base + k
                    if best > score.get(to, -np.inf):
                        score[to], back[to] = best, (at, found[1])
            if at - self.pieces.longest in score:
                del score[at - self.pieces.longest]
        self.end = max(self.end, stop)

    def _commit(self) -> Iterator[int]:
        """Settle up to the boundary in which all surviving paths meet."""
        alive = set(range(max(self.base, self.end - self.pieces.longest), self.end + 1)) | {p for p in self.back if p > self.end}
        while len(alive) > 1:
            top = max(alive)
            if top == self.base:
                break
            alive.remove(top)
            alive.add(self.back[top][0])
        meet = min(alive)
        if meet > self.base:
            yield from self._emit(meet)

    def _emit(self, upto: int) -> Iterator[int]:
        out: list[int] = []
        at = upto
        while at > self.base:
            before, piece = self.back[at]
            if piece is None:
                raw = self.pending[before - self.base : at - self.base].encode("utf-8", "surrogatepass")
                out += [self.pieces.byte_ids[b] for b in reversed(raw)]
            else:
                out.append(piece)
            at = before
        for p in range(self.base + 1, upto + 1):
            self.back.pop(p, None)
        self.pending = self.pending[upto - self.base :]
        self.base = upto
        return reversed(out)


def stream_ids(parts: Iterable[str], pieces: Pieces) -> Iterator[int]:
    """Ids of a text that comes in parts, committed as early as paths allow."""
    state = StreamingViterbi(pieces)
    first = True
    for part in parts:
        if part:
            yield from state.feed((MARK if first else "") + part.replace(" ", MARK))
            first = False
    if not first:
        yield from state.finish()


class Automaton:
    """The pieces' trie in arrays: transitions in a hash table of (node, character)."""

    def __init__(self, pieces: Pieces):
        nodes, keys, queue = 1, [], [(0, pieces.trie)]
        piece_of, score_of, letters = {}, {}, {}
        for node, children in queue:
            for c, below in children.items():
                if c == "":
                    score_of[node], piece_of[node] = below
                else:
                    keys.append((node, letters.setdefault(c, len(letters) + 1), nodes))
                    queue.append((nodes, below))
                    nodes += 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        table = np.array(keys, np.int64).reshape(-1, 3)
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(piece_of)] = list(piece_of.values())
        self.piece[0] = -1  # the root, where a walk that fails ends
        self.score = np.full(int(self.piece.max(initial=0)) + 2, -np.inf)  # the last one, at index -1, is no piece
        self.score[list(piece_of.values())] = [score_of[n] for n in piece_of]
        self.bits = max(int(4 * len(table)).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.child = np.zeros(1 << self.bits, np.int32)
        self.inner = np.zeros(nodes, bool)  # nodes that lead on
        self.inner[table[:, 0]] = True
        self.inner[0] = False
        left = np.arange(len(table))
        key = table[:, 0] * self.letters + table[:, 1]
        slot = self._slot(key)
        while len(left):
            free = self.keys[slot[left]] < 0
            first = left[free][np.unique(slot[left][free], return_index=True)[1]]
            self.keys[slot[first]], self.child[slot[first]] = key[first], table[first, 2]
            left = np.setdiff1d(left, first)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node, 0 where there is none."""
        key = node.astype(np.int64) * self.letters + code
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.child[slot], 0)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.child[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def matches(self, codes: np.ndarray, size: int, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, 0 to `longest`, the places among the first `size` where a piece of it begins, ascending, and its id."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int32)
        found = [none] * (longest + 1)
        codes = np.append(codes, np.zeros(longest, codes.dtype))  # 0 leads nowhere
        at = np.flatnonzero(codes[:size])
        node = np.zeros(len(at), np.int32)
        for length in range(1, longest + 1):
            node = self.step(node, codes[length - 1 :].take(at))
            ids = self.piece.take(node)
            ends = np.flatnonzero(ids >= 0)
            found[length] = at.take(ends), ids.take(ends)
            on = np.flatnonzero(self.inner.take(node))
            at, node = at.take(on), node.take(on)
            if not len(at):
                break
        return found


class LaneViterbi:
    """Ids of columns of texts, and their bytes again."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.auto = Automaton(self.pieces)
        sizes = np.array([len(b) for b in self.pieces.bytes_of], np.int64)
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.pieces.bytes_of), np.uint8)
        self.byte_ids = np.array(self.pieces.byte_ids, np.int32)
        self.score = self.auto.score.astype(np.float32)
        self.meetings = 0  # commits because the paths of a lane had met

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the total)."""
        parts = [MARK + t.replace(" ", MARK) + "\0" if t else "" for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        closing = ends[[bool(p) for p in parts]] - 1
        codes = self.auto.code[points]
        codes[closing] = 0  # no piece spans the end of a text
        shown = np.ones(len(points), bool)
        shown[closing] = False
        found, where, at = [], [], 0
        while at < len(codes):
            ids, places, done = self._block(points, codes, shown, at)
            found.append(ids)
            where.append(places)
            at = done
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        place = np.concatenate(where)
        return np.concatenate(found), np.concatenate([[0], np.searchsorted(place, ends)])

    def _block(self, points: np.ndarray, codes: np.ndarray, shown: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids settled from `base` on, their places, and up to where they are settled."""
        longest, size = self.pieces.longest, min(BLOCK_CHARS, len(codes) - base)
        matched = self.auto.matches(codes[base : base + size + longest], size, longest)
        reached = np.arange(1, size + 1)
        for length in range(2, longest + 1):
            reached[matched[length][0]] = matched[length][0] + length
        reached = np.maximum.accumulate(reached)
        cuts = np.append(0, np.flatnonzero(reached == np.arange(1, size + 1)) + 1)  # boundaries that all paths pass; 0 is one
        if len(cuts) == 1:
            return self._alone(points, codes, shown, base)
        long = np.flatnonzero(np.diff(cuts) > LONGEST_LANE)
        end = int(cuts[long[0]]) if len(long) else int(cuts[-1])
        if end == 0:
            return self._alone(points, codes, shown, base)
        starts = np.unique(cuts[np.searchsorted(cuts, np.arange(0, end, LANE))])
        starts = starts[starts < end]
        ids, places = self._lanes(points[base : base + end], shown[base : base + end], matched, starts, np.diff(starts, append=end))
        return ids, places + base, base + end

    def _lanes(self, points: np.ndarray, shown: np.ndarray, matched: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longest, size = self.pieces.longest, len(points)
        lengths = np.array([*range(longest, 1, -1), 0, 1])  # earlier starts win ties; 0 is the fallback
        reach = np.maximum(lengths, 1)
        bare = longest - 1  # the column of the fallback, whose cost may need more than 32 bits
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        open_ = np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 2), side="right")  # lanes that have a t-th position
        steps = np.cumsum(open_) - open_
        # rows in the order of steps, so that a step reads a stretch of memory and not a place in each lane's
        lane = np.argsort(starts)
        ahead = np.repeat(starts[lane], lens[lane])
        row = np.zeros(size + 1, np.int64)
        row[1:] = steps[np.arange(size) - ahead] + np.repeat(lane, lens[lane])
        worth = np.full((size, len(lengths)), -np.inf, np.float32)  # of the piece of each length that ends at a place; files have 32-bit scores
        worth[:, bare] = 0.0
        cells, named = worth.reshape(-1), np.full((longest + 1) * size, -1, np.int32)
        for k, length in enumerate(lengths.tolist()):
            if length:
                begins, ids = matched[length]
                inside = int(np.searchsorted(begins, size - length, side="right"))
                begins, ids = begins[:inside], ids[:inside]
                cells[row[length:].take(begins) * len(lengths) + k] = self.score.take(ids)
                named[length * size : (length + 1) * size][begins] = ids
        ring, met = np.full((len(starts), longest), -np.inf), np.zeros((len(starts), longest), np.int32)
        ring[:, 0] = 0.0
        base, mark = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        back, stops = np.zeros(size, np.uint8), np.zeros(size + 1, bool)

        def commit(lanes: np.ndarray, upto: np.ndarray) -> None:
            """Note where the pieces of the paths to `upto` end."""
            at, first = starts[lanes] + upto, starts[lanes] + base[lanes]
            base[lanes] = upto
            on = at > first
            at, first = at[on], first[on]
            while len(at):
                stops[at] = True
                at = at - reach.take(back.take(row.take(at)))
                on = np.flatnonzero(at > first)
                at, first = at.take(on), first.take(on)

        for t, (at, n, later) in enumerate(zip(steps.tolist(), open_.tolist(), open_[1:].tolist(), strict=False), 1):
            slots = (t - reach) % longest
            value = ring[:n].take(slots, axis=1)
            value += worth[at : at + n]
            value[:, bare] += self.pieces.fallback
            own = value.argmax(axis=1)
            rows = np.arange(n)
            back[at : at + n] = own
            ring[:n, t % longest] = value[rows, own]
            met[:n, t % longest] = met[rows, slots[own]]
            if later < n:
                commit(rows[later:], lens[later:n])
            if later and t % longest == 0:
                crossed = met[:later]
                one = np.flatnonzero((mark[:later] + longest <= t) & (crossed == crossed[:, :1]).all(axis=1))
                if len(one):
                    commit(one, met[one, 0])
                    self.meetings += len(one)
                    mark[one] = t
                    met[one] = t - (t - np.arange(longest)) % longest
        at = np.flatnonzero(stops)
        length = lengths[back[row[at]]]
        begins = at - np.maximum(length, 1)
        seen = shown[begins]
        return self._ids(points, named, begins[seen], length[seen])

    def _ids(self, points: np.ndarray, named: np.ndarray, begins: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at places; an uncovered character gives those of its bytes."""
        bare = np.flatnonzero(length == 0)
        ids = named.take(length * len(points) + begins)
        if not len(bare):
            return ids, begins
        raw = ["".join(map(chr, (p,))).encode("utf-8", "surrogatepass") for p in points[begins[bare]].tolist()]
        copies = np.ones(len(ids), np.int64)
        copies[bare] = [len(r) for r in raw]
        at = np.repeat(np.arange(len(ids)), copies)
        out = ids[at]
        out[length[at] == 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, begins[at]

    def _alone(self, points: np.ndarray, codes: np.ndarray, shown: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, int]:
        """One stretch without a boundary within reach: it streams on until one comes or the text ends."""
        end = base + 1 + int(np.argmin(shown[base:])) if not shown[base:].all() else len(codes)
        longest, state, ids, at = self.pieces.longest, StreamingViterbi(self.pieces), [], base
        if not shown[base]:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), base + 1
        end -= not shown[end - 1]
        while at < end:
            stop = min(at + 4 * longest, end)
            ids += state.feed(points[at:stop].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
            at = stop
        ids += state.finish()
        return np.array(ids, np.int32), np.full(len(ids), base), end

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each id's begin and the total), with the leading space of each text."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begins[ids] - (ends - sizes), sizes)], np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def coder(path: str) -> LaneViterbi:
    return LaneViterbi(path)


CODED = schema(doc_id=LONG, n_ids=LONG, ids_crc32=LONG, decoded_bytes=LONG, decoded_sha256=STR, round_trip=BOOL)


def encode_and_decode(docs: DataFrame, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and crc32 (of unsigned 32-bit ids) of each text's ids, and what they decode to."""
    path = pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for lo, hi in text_slices(batch.column("text")):
                texts, rows = batch.column("text")[lo:hi].to_pylist(), []
                ids, bounds = own.encode(texts)
                raw, begins = own.decode(ids)
                wide, data = ids.astype("<u4").tobytes(), raw.tobytes()
                for doc, text, a, b in zip(batch.column("doc_id")[lo:hi].to_pylist(), texts, bounds.tolist(), bounds[1:].tolist(), strict=False):
                    back = data[begins[a] + 1 : begins[b]] if b > a else b""
                    same = back == (text or "").encode("utf-8", "surrogatepass")
                    rows.append((doc, b - a, zlib.crc32(wide[4 * a : 4 * b]), len(back), hashlib.sha256(back).hexdigest(), same))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CODED_ARROW, strict=True)], names=CODED.names)

    ship(docs.sparkSession)
    return narrow(docs, id_col, text_col).mapInArrow(run, CODED)


_CODED_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
