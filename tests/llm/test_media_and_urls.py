"""GIF media and URL reputation."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from memlattice.llm import gif_media as G
from memlattice.llm import url_reputation as U
from memlattice.llm.queries import URL_RULES


def plain_lzw(samples, minimum, deferred=False):
    """A straightforward coder; `deferred` never clears a full table."""
    clear = 1 << minimum
    codes, table, free, width = [(clear, minimum + 1)], {}, clear + 2, minimum + 1
    prefix = samples[0]
    for c in samples[1:]:
        if (prefix, c) in table:
            prefix = table[prefix, c]
            continue
        codes.append((prefix, width))
        if free < 4096:
            table[prefix, c] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        elif not deferred:
            codes.append((clear, width))
            table, free, width = {}, clear + 2, minimum + 1
        prefix = c
    codes.append((prefix, width))
    if free == 1 << width and width < 12:
        width += 1
    codes.append((clear + 1, width))
    value = at = 0
    for code, w in codes:
        value |= code << at
        at += w
    return value.to_bytes((at + 7) // 8, "little")


@pytest.mark.parametrize("minimum", [2, 5, 8])
@pytest.mark.parametrize("deferred", [False, True])
@pytest.mark.parametrize("n", [1, 2, 700, 9000])
def test_lzw(minimum, deferred, n):
    samples = (np.random.default_rng(n).random(n) ** 3 * (1 << minimum)).astype(np.uint8)
    data = plain_lzw(samples.tolist(), minimum, deferred)
    assert (G.lzw_decode(data, minimum, n) == samples).all()
    assert (G.lzw_decode_many([(data, minimum, n)] * 2)[1] == samples).all()
    if minimum == 8 and n <= 700:
        assert G.lzw_encode([samples.tobytes()])[0] == data


def gif(frames, size=(4, 2), palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + bytes(v for c in palette for v in c)
    for (left, top, w, h), samples, delay, disposal, clear, own, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x81 if own else 0) | (0x40 if interlaced else 0))
        out += bytes(v for c in own or () for v in c) + b"\x02"
        data = plain_lzw(samples, 2)
        out += bytes([len(data)]) + data + b"\x00"
    return out + b"\x3b"


def test_disposal_transparency_palettes_and_times():
    full, small = (0, 0, 4, 2), (1, 0, 2, 2)
    own = ((1, 2, 3), (4, 5, 6), (7, 8, 9), (0, 0, 0))
    data = gif([
        (full, [0] * 8, 10, 1, None, None, False),
        (small, [1, 3, 3, 1], 20, 3, 3, None, False),
        (small, [2, 2, 2, 2], 5, 2, None, own, False),
        (full, [3, 3, 3, 3, 1, 3, 3, 3], 0, 0, 3, None, False),
    ])
    frames = G.decode_gif(data)
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 100), (100, 200), (300, 50), (350, 0)]
    red, green = (255, 0, 0, 255), (0, 255, 0, 255)
    pixel = lambda k, y, x: tuple(int(v) for v in frames[k].rgba[y, x])
    assert pixel(1, 0, 1) == green and pixel(1, 0, 2) == red  # a transparent sample shows what is below
    assert pixel(2, 0, 1) == (7, 8, 9, 255) and pixel(2, 0, 0) == red  # the second frame was taken back; own palette
    assert pixel(3, 0, 1) == (0, 0, 0, 0) and pixel(3, 1, 0) == green  # the third was cleared to nothing
    assert G.histogram(frames[0].rgba).tolist() == [0] * 7 + [8] + [8] + [0] * 7 + [8] + [0] * 7


def test_interlaced_rows():
    rows = [[i % 4] * 2 for i in range(10)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = gif([((0, 0, 2, 10), sum((rows[i] for i in order), []), 0, 0, None, None, True)], (2, 10))
    shown = G.decode_gif(data)[0].rgba
    assert all(tuple(shown[i, 0, :3]) == ((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))[i % 4] for i in range(10))


def test_media_round_trip(docs, rows, empty):
    media = G.media_from_texts(docs)
    got = {r.doc_id: r for r in G.digest_table(media).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.frames == len(payload) // 576
    frames = G.frame_table(media).where("doc_id = 0").orderBy("frame").collect()
    assert b"".join(bytes(f.rgba)[::4] for f in frames)[: got[0].n_bytes] == rows[0][1].encode()
    assert G.digest_table(G.media_from_texts(empty)).count() == 0


def test_damaged_media(spark):
    df = spark.createDataFrame([(1, 3, b"GIF89a"), (2, 3, None), (3, 3, b"no")], "doc_id long, n_bytes long, media binary")
    assert [r.payload_sha256 for r in G.digest_table(df).collect()] == [None] * 3
    assert G.frame_table(df).count() == 0


# --- urls

URLS = [
    (1, "http://A.Example.NET/en/1?x#y"), (2, "https://b.example.net/de/"), (3, "http://example.com/de/x"), (4, "http://x.org/fr/"),
    (5, "http://x.org/de/"), (6, None), (7, "no scheme"), (8, "ftp://host#frag"), (9, "a://b?c://d/e"), (10, "http://notexample.net/en/"), (11, "http://org/fr/a?b"), (11, "http://org/fr/a?b"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, none, URL_RULES).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("b.example.net", "/de/", "net/", "block")
    assert got[3] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow") and got[5] == ("x.org", "/de/", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("host", "", None, "allow") and got[9] == ("b", "", None, "allow")
    assert got[10][2] == "net/" and got[11][2] == "org/fr/"
    assert U.judge_urls(pages, none, URL_RULES).count() == len(URLS)


def test_reputation(spark):
    pages, bad = [], []
    for host, n, k in (("bad.spam.com", 40, 39), ("good.fine.com", 40, 1), ("new.spam.com", 1, 1), ("rare.fine.com", 1, 1)):
        for j in range(n):
            pages.append((len(pages), f"http://{host}/{j}"))
            bad.append((len(bad), int(j < k)))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = U.judge_urls(df, spark.createDataFrame(bad, "page_id long, bad int"))
    rates = {r.host: (r.verdict, r.bad_rate) for r in got.collect()}
    assert rates["bad.spam.com"][0] == "block" and rates["good.fine.com"][0] == "allow"
    assert rates["rare.fine.com"][0] == "allow" and rates["rare.fine.com"][1] < rates["new.spam.com"][1]  # shrunk to their domains


def test_hosts_without_labels_follow_their_domain_and_suffix(spark):
    pages, bad = [], []
    for site, k in (("spam.com", 1), ("fine.com", 0), ("other.org", 0), ("bad.co.uk", 1), ("good.co.uk", 0), ("good.com.au", 0)):
        for j in range(300):
            bad.append((len(pages), k))
            pages.append((len(pages), f"http://h{j % 3}.{site}/{j}"))
    unseen = ("new.spam.com", "new.fine.com", "a.nowhere.org", "new.bad.co.uk", "new.good.co.uk", "unseen.co.uk", "x.unknown")
    pages += [(len(pages) + j, f"http://{h}/") for j, h in enumerate(unseen)]
    got = {r.host: r for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert [got[h].verdict for h in unseen] == ["block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert all(got[h].n_labelled == 0 for h in unseen) and got["new.spam.com"].bad_rate > 0.9 > 0.1 > got["new.fine.com"].bad_rate
    assert got["a.nowhere.org"].bad_rate < got["x.unknown"].bad_rate  # a suffix without labels has the overall rate
    assert abs(got["x.unknown"].bad_rate - 1 / 3) < 0.01


def test_registered_domains(spark):
    want = {
        "a.b.com": "b.com", "com": "com", "": "", "www.shop.co.uk": "shop.co.uk", "co.uk": "co.uk", "x.y.com.au": "y.com.au", "a.b.c.ck": "b.c.ck",
        "a.www.ck": "www.ck", "w.me.github.io": "me.github.io", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp",
    }
    got = U.with_domain(spark.createDataFrame([(h,) for h in want], "host string")).collect()
    assert {r.host: r.domain for r in got} == want
