"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from memlattice.llm import importance as I

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = ["abc def the model", None, "", "école 日本語 model 12", "abc def"]


def features(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = PLAIN.findall(low)
    return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def expected(rows, target):
    """(id, n_features, weight, score, rank) per row by the contract's words."""
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    every_s, every_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * every_s / ((s[b] + 1) * every_t))) for b in range(10000)]
    out = []
    for i, w, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: len(fit) * 25 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=lambda r: r[0])


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(list(enumerate(TARGET)), "doc_id long, text string")


@pytest.mark.parametrize("block_bytes", [I.BLOCK_BYTES, 500])
def test_resample(docs, rows, target, block_bytes):
    got = I.resample(docs, target, block_bytes=block_bytes).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected([(r[0], r[1]) for r in rows], TARGET)


def test_on_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = I.resample(docs, bench.withColumnRenamed("item_id", "doc_id")).select("doc_id", "n_features", "weight", "score", "rank")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want and sum(r[4] is not None for r in want) > 20


@pytest.mark.parametrize("text", ["", "one", " one two,three  four ", "x" * 50, "- - - -", "a  " + " " * 30 + "b c", "é" * 20 + " fin.", "a b c d e f g h i j k l"])
@pytest.mark.parametrize("limit", [1, 2, 5, 9])
def test_parts_count_every_run_once(text, limit):
    words, runs = [], []
    for skip, part in I.parts_of(text, limit):
        w = PLAIN.findall(part)
        words += w[skip:]
        runs += list(zip(w, w[1:], strict=False))
    every = PLAIN.findall(text)
    assert words == every and runs == list(zip(every, every[1:], strict=False))


def test_empty_null_ids_and_repeats(spark, empty, target):
    assert I.resample(empty, target).count() == 0
    many = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(None, many)] + [(7, many)] * 6 + [(9, None)], "doc_id long, text string")
    got = I.resample(df, empty).collect()
    assert len(got) == 8 and [r.rank for r in got if r.rank] == [1] and {r.n_features for r in got if r.doc_id == 7} == {49}
    assert [(r.n_features, r.weight) for r in got if r.doc_id == 9] == [(0, 0)]


def test_scores_of_one_value_are_numbered(spark):
    rows = spark.createDataFrame([(i, 30, 59, 5, 100 + 1000 * (i % 3)) for i in range(40)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r.rank for r in I.drawn(rows).collect()}
    order = sorted(range(40), key=lambda i: (-(i % 3), i))
    assert got == {i: k + 1 if k < 10 else None for k, i in enumerate(order)}
