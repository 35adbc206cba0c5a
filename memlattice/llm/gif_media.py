"""GIF media columns: LZW decoding, palettes, disposal, transparency, timed frames.

`decode_gif` reads any GIF87a/89a: global and local palettes, interlacing, frame
offsets, delays, transparency and the disposal methods (keep, background,
previous).  LZW code streams are decoded array-wise: between two clear codes,
every code that is no literal repeats the output of an earlier code plus the
byte after it, so lengths and bytes resolve by pointer doubling.

`encode_gif` writes 8-bit samples losslessly: an identity grey palette and frames of
24 x 24 samples, each LZW-coded with a growing code width.

Tables: `media_from_bytes` stores a payload column as GIF files; `frame_table`
gives one row per frame with its time, size, RGB histogram columns and optional
pixels; `digest_table` gives one row per file of hashes read back from it.

Defined results: a null text is an empty payload, which is padded like any
other; a null or damaged file gives no frames and a null digest; rows that
repeat are stored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memlattice.llm.packing import text_slices
from memlattice.llm.shared import BIN, INT, LONG, STR, narrow, schema, ship

SIDE = 24
FRAME = SIDE * SIDE
#: Bins of a colour histogram, per channel.
HISTOGRAM_BINS = 8
_GREY = bytes(v for g in range(256) for v in (g, g, g))


# --- LZW -----------------------------------------------------------------------


def _widths(minimum: int) -> np.ndarray:
    """Width of the i-th code after a clear code, up to a full table."""
    clear = 1 << minimum
    free = 4096 - clear - 2
    i = np.arange(free + 2)
    top = clear + 1 + np.maximum(i - 1, 0) + (i > 0)  # entries once code i is to be read
    width = np.full(len(i), minimum + 1)
    for w in range(minimum + 1, 12):
        width[top + 0 >= (1 << w)] = w + 1
    return np.minimum(width, 12)


_WIDTHS = {m: _widths(m) for m in range(2, 9)}


def lzw_decode(data: bytes, minimum: int, expected: int) -> np.ndarray:
    """Indices of a code stream; at most `expected` of them."""
    bits = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total = len(data) * 8
    clear, end = 1 << minimum, (1 << minimum) + 1
    widths = _WIDTHS[minimum]
    offsets = np.concatenate([[0], np.cumsum(widths)])
    out: list[np.ndarray] = []
    made, at, done = 0, 0, False
    while not done and at + minimum + 1 <= total and made < expected:
        n = min(len(widths), int(np.searchsorted(offsets, total - at, side="right")) - 1, expected - made + 2)
        where = at + offsets[:n]
        w = widths[:n]
        if n == len(widths) and expected - made + 2 > n:  # codes after the table is full keep 12 bits
            more = min((total - at - int(offsets[n])) // 12, expected - made + 2 - n)
            if more > 0:
                where = np.concatenate([where, at + offsets[n] + 12 * np.arange(more)])
                w = np.concatenate([w, np.full(more, 12)])
        byte = where >> 3
        word = bits[byte] | (bits[byte + 1] << np.uint32(8)) | (bits[byte + 2] << np.uint32(16))
        codes = ((word >> (where & 7).astype(np.uint32)) & ((np.uint32(1) << w.astype(np.uint32)) - np.uint32(1))).astype(np.int64)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if len(stop):
            at, done = int(where[stop[0]] + w[stop[0]]), codes[stop[0]] == end
            codes = codes[: stop[0]]
        else:
            at, done = total, True
        if len(codes):
            out.append(_expand(codes, clear)[0])
            made += len(out[-1])
    return np.concatenate(out)[:expected] if out else np.zeros(0, np.uint8)


def _expand(codes: np.ndarray, clear: int, at: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes between two clear codes, and how many each code gives.

    `at` is where each code's own stream begins, for streams one after another.
    """
    order = np.arange(len(codes))
    back = codes - (clear + 2) + at  # entry j repeats the output of code j and one byte more
    literal = codes < clear
    if ((back >= order) & ~literal).any():
        raise ValueError("a code is used before it is defined")
    parent = np.where(literal, order, back)
    hops, up = (~literal).astype(np.int64), parent
    while True:
        further = up[up]
        if np.array_equal(further, up):
            break
        hops = hops + hops[up]
        up = further
    length = 1 + hops
    start = np.cumsum(length) - length
    shift = (start[parent] - start).astype(np.int64)
    source = np.arange(int(length.sum())) + np.repeat(shift, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    values = np.zeros(len(source), np.uint8)
    values[start[literal]] = codes[literal]
    return values[source], length


def lzw_codes(samples: bytes, minimum: int = 8) -> list[int]:
    """Codes of at most 3,838 samples, which never fill the table."""
    table: dict[int, int] = {}
    find = table.get
    codes = [1 << minimum]
    put = codes.append
    free = (1 << minimum) + 2
    prefix = samples[0]
    for c in samples[1:]:
        key = prefix << 8 | c
        known = find(key)
        if known is None:
            put(prefix)
            table[key] = free
            free += 1
            prefix = c
        else:
            prefix = known
    put(prefix)
    put((1 << minimum) + 1)
    return codes


def lzw_encode(frames: list[bytes], minimum: int = 8) -> list[bytes]:
    """Code streams of some frames, packed into bits together."""
    codes = [lzw_codes(f, minimum) for f in frames]
    n = np.array([len(c) for c in codes])
    offsets = np.concatenate([[0, minimum + 1], minimum + 1 + np.cumsum(_WIDTHS[minimum])])
    size = (offsets[n] + 7) // 8
    base = np.cumsum(size) - size
    first = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(first, n)
    where = np.repeat(base * 8, n) + offsets[nth]
    shifted = np.array([c for some in codes for c in some], np.uint32) << (where & 7).astype(np.uint32)
    byte, total = where >> 3, int(size.sum())
    out = sum(np.bincount(byte + k, weights=(shifted >> np.uint32(8 * k)) & np.uint32(255), minlength=total + 3) for k in range(3))
    raw = out.astype(np.uint8).tobytes()
    return [raw[a : a + b] for a, b in zip(base.tolist(), size.tolist(), strict=True)]


def lzw_decode_many(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """`lzw_decode` of (data, minimum, expected) items.

    Streams with one clear code, at their start, and one end code are
    expanded together; any other goes by itself.
    """
    out: list[np.ndarray | None] = [None] * len(streams)
    for minimum in {m for _, m, _ in streams}:
        some = [i for i, (d, m, n) in enumerate(streams) if m == minimum and len(d) > 1 and n < 3000]
        if not some:
            continue
        clear, end = 1 << minimum, (1 << minimum) + 1
        offsets = np.concatenate([[0, minimum + 1], minimum + 1 + np.cumsum(_WIDTHS[minimum])])
        sizes = np.array([len(streams[i][0]) for i in some])
        base = np.cumsum(sizes) - sizes
        bits = np.concatenate([np.frombuffer(b"".join(streams[i][0] for i in some), np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        n = np.searchsorted(offsets, sizes * 8, side="right") - 1
        first = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(first, n)
        where = np.repeat(base * 8, n) + offsets[nth]
        width = (offsets[nth + 1] - offsets[nth]).astype(np.uint32)
        byte = where >> 3
        word = bits[byte] | (bits[byte + 1] << np.uint32(8)) | (bits[byte + 2] << np.uint32(16))
        codes = ((word >> (where & 7).astype(np.uint32)) & ((np.uint32(1) << width) - np.uint32(1))).astype(np.int64)
        stop = np.where(((codes == clear) | (codes == end)) & (nth > 0), nth, len(offsets))
        stops = np.minimum.reduceat(stop, first) if len(first) else stop
        plain = (codes[first] == clear) & (stops > 1) & (stops < n)
        plain &= codes[first + np.minimum(stops, n - 1)] == end
        if not plain.any():
            continue
        inside = np.repeat(plain, n) & (nth > 0) & (nth < np.repeat(stops, n))
        taken = np.where(plain, stops - 1, 0)
        at = np.repeat((np.cumsum(taken) - taken)[plain], taken[plain])
        values, lengths = _expand(codes[inside], clear, at)
        size = np.add.reduceat(lengths, (np.cumsum(taken) - taken)[plain])
        ends = np.cumsum(size)
        for i, lo, hi in zip(np.array(some)[plain].tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
            out[i] = values[lo:hi][: streams[i][2]]
    return [lzw_decode(*streams[i]) if x is None else x for i, x in enumerate(out)]


# --- container -----------------------------------------------------------------


@dataclass(frozen=True)
class Image:
    """A frame as stored, before it is drawn."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int | None


@dataclass(frozen=True)
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    images: list[Image]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


Stream = tuple[bytes, int, int]


def _parsed(data: bytes) -> tuple[Gif, list[tuple[Stream, tuple]]]:
    """A file without its samples, and each frame's code stream and place."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    found: list[tuple[Stream, tuple]] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0], body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, local)
            minimum = data[at]
            if not 2 <= minimum <= 8:
                raise ValueError("bad LZW code size")
            body, at = _blocks(data, at + 1)
            palette = own if own is not None else shared
            if palette is None:
                raise ValueError("a frame has no palette")
            found.append(((body, minimum, w * h), (left, top, w, h, local & 0x40, palette, delay, disposal, transparent)))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")
    return Gif(width, height, background, shared, []), found


def parse_gifs(files: list[bytes]) -> list[Gif]:
    """Several files, their code streams expanded together."""
    parts = [_parsed(data) for data in files]
    samples = iter(lzw_decode_many([stream for _, found in parts for stream, _ in found]))
    for gif, found in parts:
        gif.images.extend(Image(*place[:4], _shaped(next(samples), *place[2:5]), *place[5:]) for _, place in found)
    return [gif for gif, _ in parts]


def _shaped(samples: np.ndarray, w: int, h: int, interlaced: int) -> np.ndarray:
    """Rows from top to bottom; samples that the stream lacks are 0."""
    if len(samples) < w * h:
        samples = np.concatenate([samples, np.zeros(w * h - len(samples), np.uint8)])
    stored = samples.reshape(h, w)
    if not interlaced:
        return stored
    rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
    straight = np.empty_like(stored)
    straight[rows] = stored
    return straight


@dataclass(frozen=True)
class Frame:
    number: int
    start_ms: int
    delay_ms: int
    rgba: np.ndarray


def decode_gif(data: bytes) -> list[Frame]:
    """Frames as shown: each drawn over what disposal left of those before."""
    return shown(parse_gifs([data])[0])


def shown(gif: Gif) -> list[Frame]:
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    out, clock, last, colours = [], 0, None, None
    for k, image in enumerate(gif.images):
        before = canvas.copy() if image.disposal == 3 else None
        area = canvas[image.top : image.top + image.height, image.left : image.left + image.width]
        drawn = image.indices[: area.shape[0], : area.shape[1]]
        if image.palette is not last:
            last, colours = image.palette, np.full((256, 4), 255, np.uint8)
            colours[len(last) :, :3] = 0
            colours[: len(last), :3] = last
        if image.transparent is None:
            area[:] = colours[drawn]
        else:
            show = drawn != image.transparent
            area[show] = colours[drawn[show]]
        out.append(Frame(k, clock, image.delay * 10, canvas.copy()))
        clock += image.delay * 10
        if image.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
    return out


def encode_gifs(payloads: list[bytes], delay: int = 4) -> list[bytes]:
    """GIFs whose frames of 24 x 24 grey samples are the payloads, each a multiple of 576 bytes."""
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREY
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0)
    place = control + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    coded = iter(lzw_encode([p[at : at + FRAME] for p in payloads for at in range(0, len(p), FRAME)]))
    files = []
    for payload in payloads:
        out = [head]
        for _ in range(0, len(payload), FRAME):
            codes = next(coded)
            out.append(place)
            for lo in range(0, len(codes), 255):
                part = codes[lo : lo + 255]
                out += [bytes([len(part)]), part]
            out.append(b"\x00")
        out.append(b"\x3b")
        files.append(b"".join(out))
    return files


def encode_gif(payload: bytes, delay: int = 4) -> bytes:
    return encode_gifs([payload], delay)[0]


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    return raw + b"\xff" * (size - len(raw))


# --- tables --------------------------------------------------------------------

MEDIA = schema(doc_id=LONG, n_bytes=LONG, media=BIN)
#: Bytes coded or decoded together in a task.
BATCH_BYTES = 1 << 19


def media_from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column("text"), BATCH_BYTES):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")[lo:hi]]
                media = encode_gifs([padded(raw) for raw in texts])
                sizes = [len(raw) for raw in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=MEDIA.names)

    ship(docs.sparkSession)
    return narrow(docs, id_col, text_col).mapInArrow(run, MEDIA)


def histogram(rgba: np.ndarray, bins: int = HISTOGRAM_BINS) -> np.ndarray:
    """Visible pixels by channel and bin, red, then green, then blue."""
    flat = rgba.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0][:, :3].astype(np.int64) * bins // 256
    return np.concatenate([np.bincount(flat[:, c], minlength=bins) for c in range(3)])


FRAMES = schema(
    doc_id=LONG, frame=INT, start_ms=LONG, delay_ms=INT, width=INT, height=INT,
    red=T.ArrayType(LONG), green=T.ArrayType(LONG), blue=T.ArrayType(LONG), rgba=BIN,
)


def frame_table(media: DataFrame, pixels: bool = True) -> DataFrame:
    """One row per frame of (doc_id, media): time, size, histogram columns and RGBA bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for row, _, frames in _decoded(batch.column("media")):
                doc, rows = docs[row], []
                for f in frames:
                    h = histogram(f.rgba).reshape(3, -1).tolist()
                    rows.append((doc, f.number, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], *h, f.rgba.tobytes() if pixels else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FRAMES_ARROW, strict=True)], names=FRAMES.names)

    ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, FRAMES)


_FRAMES_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]


_DAMAGED = (ValueError, IndexError, struct.error)


def _decoded(col: pa.Array) -> Iterator[tuple[int, bytes | None, list[Frame]]]:
    """(row, file, frames) of a binary column; a null or damaged file has no frames."""
    for lo, hi in text_slices(col, BATCH_BYTES):
        files = col[lo:hi].to_pylist()
        some = [x for x in files if x]
        try:
            gifs = iter(parse_gifs(some))
        except _DAMAGED:
            gifs = iter([_one(x) for x in some])
        for k, data in enumerate(files):
            gif = next(gifs) if data else None
            yield lo + k, data, shown(gif) if gif else []


def _one(data: bytes) -> Gif | None:
    try:
        return parse_gifs([data])[0]
    except _DAMAGED:
        return None


DIGEST = schema(doc_id=LONG, n_bytes=LONG, payload_bytes=LONG, payload_sha256=STR, tail_crc32=LONG, media_bytes=LONG, media_sha256=STR, feature=STR, frames=INT, duration_ms=LONG)


def digest_table(media: DataFrame) -> DataFrame:
    """Hashes, duration and summed grey histogram of the payload that each stored file holds."""

    def one(doc: int | None, n: int | None, data: bytes | None, frames: list[Frame]) -> tuple:
        if not frames:
            return (doc, n, *[None] * 8)
        grey = np.stack([f.rgba[:, :, 0] for f in frames])
        payload = grey.tobytes()
        counts = np.bincount(grey.reshape(-1) >> 5, minlength=HISTOGRAM_BINS)
        last = frames[-1]
        feature = f"{len(frames)}x{last.rgba.shape[1]}x{last.rgba.shape[0]}:" + ",".join(map(str, counts.tolist()))
        return (
            doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
            hashlib.sha256(data).hexdigest(), feature, len(frames), last.start_ms + last.delay_ms,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            rows = [one(docs[k], sizes[k], data, frames) for k, data, frames in _decoded(batch.column("media"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST_ARROW, strict=True)], names=DIGEST.names)

    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


_DIGEST_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
