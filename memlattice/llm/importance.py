"""Target-distribution importance resampling on hashed word n-grams.

DuckDB works inside each task, on blocks of at most BLOCK_BYTES of text: its SQL lower-cases,
extracts and unnests the words, a window over each text's words makes the runs of one and
two, and a registered function over zlib's CRC-32 hashes them.  Per text it returns the
buckets of its runs with their counts, and per batch the counts of all buckets; both
are spilled to Parquet in the shared folder.  Spark sums the bucket counts of the corpus and of the
target, and scores every text from its spilled row with one array of gains (as many
integers as buckets); texts are read once.

A longer text is a block of its own and is cut behind characters that belong to no word; a part
begins with the last word before it, which is not counted again but begins a run of two.

Ranks are global and no task orders all rows: scores are whole numbers in a range that the
number of buckets and the 2^32 draws fix, so two small tables say how many rows lie
above each score, and rows of one score are numbered among themselves.

Defined results: a null or empty text has no words, no features and weight 0; rows that repeat are
rows of their own (ties of score and id go by weight, then by features); a null id hashes as the empty
string and comes first among ties; an empty table gives no rows, an empty target only T = 0; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm.bytekernel import row_blocks, text_bytes
from memlattice.llm.shared import BOOL, LONG, narrow, schema, ship, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text that DuckDB is given at once, and its memory; it has no folder to spill to.
BLOCK_BYTES, MEMORY = 2 << 20, "500MB"
#: What words are made of, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SPILLED = schema(total=BOOL, doc_id=LONG, n_words=LONG, buckets=T.ArrayType(LONG), counts=T.ArrayType(LONG))
_LISTS = pa.list_(pa.int64())

#: parts(r, skip, text): texts by number; skip is 1 where the first word was counted before.
FEATURES_SQL = f"""
    WITH found AS (
        SELECT r, skip, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM parts
    ), words AS (
        SELECT r, skip, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM found
    ), runs AS (
        SELECT r, skip, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS after FROM words
    ), features AS (
        SELECT r, w AS feature FROM runs WHERE i >= skip
        UNION ALL SELECT r, w || ' ' || after FROM runs WHERE after IS NOT NULL
    ), held AS (
        SELECT r, crc(feature) % $buckets AS bucket, count(*) AS n FROM features GROUP BY ALL
    ), listed AS (
        SELECT r, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM held GROUP BY r
    )
    SELECT r, (len(ws) - skip)::BIGINT AS n_words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
    FROM found LEFT JOIN listed USING (r) ORDER BY r"""


def _crc(column: pa.ChunkedArray) -> pa.Array:
    raw, offsets = text_bytes(column)
    data, at = raw.tobytes(), offsets.tolist()
    return pa.array([crc32(data[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)], pa.int64())


@lru_cache(maxsize=1)
def _engine():
    """The worker's DuckDB: one thread, bounded memory, no files."""
    import duckdb

    engine = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    engine.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return engine


def _features(texts: pa.Array, skip: int, buckets: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words, buckets and counts as lists) of each text, by DuckDB."""
    n = len(texts)
    engine = _engine()
    engine.register("parts", pa.table({"r": pa.array(range(n), pa.int64()), "skip": pa.array([skip] * n, pa.int64()), "text": texts}))
    found = engine.sql(FEATURES_SQL, params={"buckets": buckets}).to_arrow_table().combine_chunks()
    engine.unregister("parts")
    lists = [found[c].combine_chunks().cast(_LISTS) for c in ("buckets", "counts")]
    return found["n_words"].to_numpy(), lists[0], lists[1]


def parts_of(text: str, limit: int) -> Iterator[tuple[int, str]]:
    """(skip, part): parts of about `limit` characters; skip is 1 where the last word before it was put in front."""
    at, last = 0, ""
    while at < len(text):
        cut = _OUTSIDE.search(text, at + limit - 1) if at + limit < len(text) else None
        end = cut.end() if cut else len(text)
        yield (1, f"{last} {text[at:end]}") if last else (0, text[at:end])
        stop = end
        while stop > at and _OUTSIDE.match(text, stop - 1):
            stop -= 1
        begin = stop
        while begin > at and not _OUTSIDE.match(text, begin - 1):
            begin -= 1
        at, last = end, text[begin:stop] or last


def _long_text(text: str, buckets: int, limit: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The same of one long text, part by part."""
    words, sums = 0, np.zeros(buckets, np.int64)
    for skip, part in parts_of(text, limit):
        n, where, counts = _features(pa.array([part], pa.string()), skip, buckets)
        words += int(n[0])
        sums[where.values.to_numpy()] += counts.values.to_numpy()
    at = np.flatnonzero(sums)
    return np.array([words]), pa.array([at], _LISTS), pa.array([sums[at]], _LISTS)


def spilled_features(docs: DataFrame, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of texts (doc_id, n_words, buckets, counts), and with total = true the sums of a batch of texts."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sums = batch.column(1).fill_null(""), np.zeros(buckets, np.int64)
            _, offsets = text_bytes(texts)
            for lo, hi in row_blocks(offsets, block_bytes):
                if offsets[hi] - offsets[lo] > block_bytes:
                    n, where, counts = _long_text(texts[lo].as_py(), buckets, block_bytes)
                else:
                    n, where, counts = _features(texts[lo:hi], 0, buckets)
                sums += np.bincount(where.flatten().to_numpy(), counts.flatten().to_numpy(), buckets).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([False] * (hi - lo)), batch.column(0)[lo:hi], pa.array(n, pa.int64()), where, counts], names=SPILLED.names)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([True]), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([at], _LISTS), pa.array([sums[at]], _LISTS)], names=SPILLED.names
            )

    return narrow(docs).mapInArrow(work, SPILLED)


def bucket_counts(spilled: DataFrame) -> DataFrame:
    """(bucket, n): the sums of all batches."""
    each = spilled.where("total").select(F.explode_outer(F.arrays_zip("buckets", "counts")).alias("_b")).where("_b IS NOT NULL")
    return each.groupBy(F.col("_b.buckets").alias("bucket")).agg(F.sum("_b.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of each bucket's log ratio of target to corpus, one added to every count; at most `buckets` rows reach the driver."""
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))
    every_s, every_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * every_s / (float(s.get(b, 0) + 1) * every_t))) for b in range(buckets)]


def _floored(total: Column, n: Column) -> Column:
    """Whole quotient, rounded down; 0 for none."""
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def scored(spilled: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each text."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda acc, x: acc + F.get(table, x["buckets"].cast("int")) * x["counts"])
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = spilled.where("NOT total").select("doc_id", "n_words", (F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))).alias("n_features"), total.alias("_sum"))
    weighed = rows.select("doc_id", "n_words", "n_features", _floored(F.col("_sum"), F.col("n_features")).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + luck)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank (1, 2, ...) to the `percent` of highest scores among texts of `least_words` words; null for the rest."""
    fit = F.col("n_words") >= least_words
    band = F.floor(F.col("score") / 1000)
    counts = rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_band", band)
    inside = Window.partitionBy("_band").orderBy(F.desc("score"))
    bands = counts.groupBy(F.col("_band").alias("_b")).agg(F.sum("_n").alias("_all"))
    down = Window.orderBy(F.desc("_b"))  # some hundred rows: the range of scores in steps of 1,000
    bands = bands.select("_b", (F.sum("_all").over(down) - F.col("_all")).alias("_above"), F.sum("_all").over(Window.partitionBy(F.lit(1))).alias("_fit"))
    places = counts.withColumn("_higher", F.sum("_n").over(inside) - F.col("_n")).join(F.broadcast(bands), F.col("_band") == F.col("_b"))
    places = places.select(F.col("score").alias("_score"), (F.col("_above") + F.col("_higher")).alias("_before"), F.floor(F.col("_fit") * percent / 100).alias("_most"))
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "weight", "n_features")
    ranked = rows.where(fit).join(places, F.col("score") == F.col("_score")).withColumn("_rank", F.col("_before") + F.row_number().over(among))
    rank = F.when(F.col("_rank") <= F.col("_most"), F.col("_rank")).cast("long")
    return ranked.select(*rows.columns, rank.alias("rank")).unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all texts of `docs`, drawn towards the texts of `target`."""
    spilled = written(spilled_features(docs, buckets, block_bytes), "buckets", compression="zstd")
    wanted = written(spilled_features(target, buckets, block_bytes), "target-buckets", compression="zstd")
    gain = gains(bucket_counts(spilled), bucket_counts(wanted), buckets)
    return drawn(written(scored(spilled, gain, seed), "scores"), percent, least_words)
