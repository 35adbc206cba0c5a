"""Id sets, components and word hashing."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlattice.llm import bytekernel as B
from memlattice.llm.components import connected_components
from memlattice.llm.membership import with_ids, without_rows
from memlattice.llm.wordbpe import WordBpe, default_vocabulary


@pytest.mark.parametrize("buckets", [1, 64])
def test_id_sets_are_exact_even_when_the_bitmap_is_full(spark, buckets):
    docs = spark.range(3000).selectExpr("id AS doc_id", "id % 7 AS _own", "id % 5 AS _p", "'x' AS _maybe", "1 AS _row").union(spark.createDataFrame([(None, 1, 1, "x", 1)], "doc_id long, _own long, _p long, _maybe string, _row int"))
    ids = spark.range(0, 3000, 3).selectExpr("id AS doc_id", "id % 7 AS digest", "false AS once")
    kept = without_rows(docs, ids, F.col("_own"), buckets=buckets)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(i for i in range(3000) if i % 3)}
    assert {r.doc_id for r in with_ids(docs, ids, buckets=buckets).collect()} == set(range(0, 3000, 3))


def test_rows_of_one_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (1, "b", 7), (2, "b", 6), (None, "a", 5), (None, "a", 4)], "doc_id long, text string, _bits int")
    marks = spark.createDataFrame([(1, "a", True), (2, "b", False), (None, "a", True)], "doc_id long, digest string, once boolean")
    assert sorted(map(tuple, without_rows(docs, marks, F.col("text")).collect()), key=str) == sorted([(1, "a", 8), (1, "b", 7), (None, "a", 4)], key=str)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root(n) for p in pairs if p[0] != p[1] for n in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_do_not_depend_on_the_block():
    texts = ["A b  c", "", None, "é\tB", " x ", "b" * 5000, "a\nB\r\x0b\x0cc"]
    raw, offsets = B.text_bytes(pa.array(texts))
    h, at = B.word_hashes(raw, offsets)
    assert np.diff(at).tolist() == [3, 0, 0, 2, 1, 1, 3]
    for i, t in enumerate(texts):
        alone, _ = B.word_hashes(*B.text_bytes(pa.array([t], pa.string())))
        assert alone.tolist() == h[at[i] : at[i + 1]].tolist()
    assert h[0] == h[at[6]] and h[1] == h[at[6] + 1] == h[at[3] + 1]  # a, b and B


def test_cached_encoding_equals_the_library():
    coder = WordBpe(default_vocabulary(), cache_runs=3)
    texts = ["It's a test, isn't it?", "a<|endoftext|>b c", "x\x1cy　z", "É é ß İ ΣΑΣ", "word*** 12,5 (a) 's ' '' 'll", "tokens\n\n tokens", "", None, "ﬁ ½ é"]
    for _ in range(3):
        for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
            assert ids.tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids
