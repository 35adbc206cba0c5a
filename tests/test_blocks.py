"""Blocks of vectors: both sides meet in every block, and a task holds one tile of similarities."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from memlattice.operators import classes as K
from memlattice.operators import vectors as V


@pytest.fixture
def apart(spark):
    """Partitions stay as many as they are, as they do where there is much data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_block_of_entities_meets_every_block_of_classes(spark, apart):
    rng = random.Random(3)
    vector = lambda: [float(rng.randint(-9, 9)) for _ in range(4)]
    e, c = [(i, vector()) for i in range(60)], [(i, vector()) for i in range(23)]
    got = K.nearest_classes(spark.createDataFrame(e, "entity long, vector array<double>"), spark.createDataFrame(c, "class long, vector array<double>"), 3, block_rows=7).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, j, dot(v, w)) for i, v in e for j, w in sorted(c, key=lambda r: (-dot(v, r[1]), r[0]))[:3]}
    assert {(r["entity"], r["class"], r["score"]) for r in got} == want and len(got) == 180


def batches(x, ids, size):
    for at in range(0, len(ids), size):
        rows = pa.array(x[at : at + size].tolist(), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + size]), rows], names=["vec_id", "embedding"])


def nearest(x, ids, queries, k, size):
    shared = SimpleNamespace(value=(ids[queries], x[queries] / np.linalg.norm(x[queries], axis=1, keepdims=True)))
    out = next(V._nearest(shared, k, x.shape[1])(batches(x, ids, size)))
    return set(zip(*(out.column(c).to_pylist() for c in ("query_id", "vec_id", "similarity")), strict=True))


@pytest.mark.parametrize("tile", [(256, 2048), (3, 5), (1, 1)])
def test_tiles_keep_the_nearest_and_the_first_of_equal_ones(monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    x[(x == 0).all(axis=1)] = 1
    ids = rng.permutation(90).astype(np.int64)
    queries = np.arange(0, 90, 9)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in queries:
        s = np.round(unit[q] @ unit.T, 9)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:7]
        want |= {(int(ids[q]), int(ids[j])) for j in order}
    assert {(a, b) for a, b, _ in nearest(x, ids, queries, 7, 40)} == want
    assert len(nearest(x[:3], ids[:3], np.arange(3), 7, 2)) == 6


def test_memory_of_a_task_does_not_grow_with_block_and_batch():
    x = np.random.default_rng(6).normal(size=(10_000, 4))
    rows = list(batches(x, np.arange(10_000), 10_000))
    shared = SimpleNamespace(value=(np.arange(2000), x[:2000]))
    tracemalloc.start()
    next(V._nearest(shared, 10, 4)(iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
