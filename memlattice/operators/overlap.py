"""Pairs of sets with much in common: an exact join in blocks that writes no candidate pairs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised

#: Rows of a block at most, and blocks that smaller inputs have (of SMALL_ROWS or more) so that all cores get some.
BLOCK_ROWS, BLOCKS, SMALL_ROWS = 16384, 8, 1024
#: Columns of the bound: the most frequent items have one each, all others share the rest by a hash.
OWN, COLUMNS = 256, 512
#: Rows of either side whose bounds are held at a time, and pairs that are counted exactly at a time.
TILE, PAIRS = (1024, 4096), 1 << 15
#: Workers get these functions themselves, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _coded(sets: DataFrame) -> DataFrame:
    """(id, n, codes, columns): sets with numbers for items that more than one of them has."""
    items = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    freq = materialised(items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("code", F.monotonically_increasing_id()))
    own = freq.orderBy(F.desc("df"), "item").limit(OWN).select("code").collect()
    place = sets.sparkSession.createDataFrame([(r.code, i) for i, r in enumerate(own)], "code long, place int")
    rest = F.lit(OWN) + F.pmod(F.xxhash64("code"), F.lit(COLUMNS - OWN)).cast("int")
    known = freq.join(F.broadcast(place), "code", "left").select("item", F.struct("code", F.coalesce("place", rest).alias("col")).alias("_c"))
    rows = items.join(known, "item").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("_c")).alias("_c"))
    return rows.select("id", "n", F.col("_c.code").alias("codes"), F.col("_c.col").alias("columns"))


def overlapping_pairs(sets: DataFrame, least: int = 1, ratio: float = 0.0) -> DataFrame:
    """(a, b, common, n_a, n_b): pairs of sets, a < b, with `least` items in common or more and a Jaccard similarity of `ratio` or more.

    `sets` has id (string, unique) and items (distinct).  Sets are dealt into blocks by a hash of their ids, and every pair of blocks is one
    group: a set is shuffled once per block, pairs are not.  In a group, a matrix product over COLUMNS columns bounds how many items two
    sets share from above (items of one column count as shared), and only pairs whose bound reaches what is asked are
    counted on their full sets.  So the result is exact; the work grows with the square of the sets, the memory of a task does not grow.

    Defined results: null ids and sets give no rows, sets without items neither.
    """
    known = sets.where("id IS NOT NULL AND items IS NOT NULL")
    rows = materialised(_coded(known).where((F.size("codes") >= max(least, 1)) & (F.size("codes") >= F.col("n") * F.lit(ratio) - 1e-6)))
    n = rows.count()
    blocks = max(-(-n // BLOCK_ROWS), min(BLOCKS, -(-n // SMALL_ROWS)), 1)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = rows.withColumn("_x", block).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("id", "n", "codes", "columns", (F.least("_x", "_y") * blocks + F.greatest("_x", "_y")).alias("pair"), (F.col("_x") > F.col("_y")).alias("right"), (F.col("_x") == F.col("_y")).alias("own"))
    dealt = met.repartition(min(blocks * (blocks + 1), 4000), "pair")
    return dealt.groupBy("pair").applyInArrow(_met(least, ratio), "a string, b string, common long, n_a long, n_b long")


def _met(least: int, ratio: float):
    share = ratio / (1 + ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("id")  # so places are in the order of ids
        size = table["n"].to_numpy().astype(np.int64)
        lists = table["codes"].combine_chunks()
        begin = lists.offsets.to_numpy().astype(np.int64)
        code, column = lists.flatten().to_numpy(), table["columns"].combine_chunks().flatten().to_numpy()
        begin -= begin[0]
        count = np.diff(begin)
        names, code = np.unique(code, return_inverse=True)
        row = np.repeat(np.arange(len(size)), count)
        keys = np.sort(row * len(names) + code)
        own, right = table["own"][0].as_py(), np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        left = np.flatnonzero(~table["right"].to_numpy(zero_copy_only=False))
        right = left if own else right
        slack = 0.01 + 1e-5 * size.max()

        def matrix(some: np.ndarray, mine: bool) -> np.ndarray:
            """Items by column; the last two columns take what a pair needs from the product."""
            at = np.repeat(np.arange(len(some)), count[some])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + np.repeat(begin[some], count[some])
            flat = np.bincount(at * (COLUMNS + 2) + column[inside], minlength=len(some) * (COLUMNS + 2))
            x = flat.reshape(len(some), COLUMNS + 2).astype(np.float32)
            x[:, COLUMNS + mine], x[:, COLUMNS + 1 - mine] = 1, -share * size[some]
            return x

        def counted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """How many items pairs of rows share."""
            at = np.repeat(np.arange(len(a)), count[a])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(count[a]) - count[a], count[a]) + np.repeat(begin[a], count[a])
            want = b[at] * len(names) + code[inside]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.bincount(at[keys[place] == want], minlength=len(a))

        for lo in range(0, len(left), TILE[0]):
            mine = left[lo : lo + TILE[0]]
            x = matrix(mine, True)
            for at in range(0, len(right), TILE[1]):
                other = right[at : at + TILE[1]]
                if own and other[-1] <= mine[0]:
                    continue
                bound = x @ matrix(other, False).T
                need = least - slack if not ratio else -slack
                hit = np.flatnonzero(bound.ravel() >= need)
                a, b = mine[hit // len(other)], other[hit % len(other)]
                if own:
                    a, b = a[a < b], b[a < b]
                a, b = np.minimum(a, b), np.maximum(a, b)
                for k in range(0, len(a), PAIRS):
                    p, q = a[k : k + PAIRS], b[k : k + PAIRS]
                    common = counted(p, q)
                    ok = (common >= max(least, 1)) & (common / (size[p] + size[q] - common) >= ratio)
                    if ok.any():
                        p, q, common = p[ok], q[ok], common[ok]
                        ids = [table["id"].take(pa.array(r)).combine_chunks() for r in (p, q)]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(common), pa.array(size[p]), pa.array(size[q])], names=["a", "b", "common", "n_a", "n_b"])

    return run
