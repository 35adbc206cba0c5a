"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter trigrams: UTF-8 bytes, A-Z lower-cased, all
ASCII non-letters one gap, a gap before and after the text; trigrams are hashed to
`dims` cells, weighted log(1 + tf) * idf and normalised.  Each labelled language gets
`clusters` centroids by spherical k-means, and a text takes the language of the
centroid of highest cosine.

Cosines grow with the number of different trigrams, of a language's texts as of
gibberish, so the distance at which a text is rejected depends on that number.  The
rows that fit a language's centroids, and windows of 1, 2, 4, ... words of them, are put into
bands by their number of different trigrams (1, 2-3, 4-7, ...); a band's floor is `reject`
times the `quantile` quantile of their cosines.  A text is rejected when its cosine to
the nearest centroid is below the floor of that centroid's language and its own band,
or when it has no letter.

Document frequencies cover all training rows; the k-means of a language and its
floors use at most about `fit_rows` of its rows, drawn by a hash of the id.

Defined results: a null, empty or letterless text is `und` with score 0 and
rejected; so is every text where no training row exists.  Rows that repeat are
predicted each; an empty table gives no rows; columns other than id, text and
label are ignored, and the label is read in training rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.bytekernel import row_blocks, text_bytes
from memlattice.llm.membership import without_rows
from memlattice.llm.shared import BOOL, DBL, INT, LONG, STR, schema, ship

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    dims: int = 4096
    clusters: int = 4
    fit_rows: int = 1000
    rounds: int = 8
    quantile: float = 0.001
    reject: float = 0.45
    bands: int = 12
    least_members: int = 50


_CELL = np.full(256, 0x20, np.uint8)
_CELL[97:123] = np.arange(97, 123)
_CELL[65:91] = np.arange(97, 123)
_CELL[128:] = np.arange(128, 256)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """(rows, dims) float32 counts of letter trigrams of texts between two gaps."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros((n, dims), np.float32)
    sizes = np.diff(offsets)
    b = np.full(len(raw) + 2 * n, 0x20, np.uint8)
    b[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, sizes)] = _CELL[raw]
    code = (b[:-2].astype(np.uint32) << np.uint32(16)) | (b[1:-1].astype(np.uint32) << np.uint32(8)) | b[2:]
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(dims).bit_length() + 1)
    row = np.repeat(np.arange(n), sizes + 2)
    inside = row[:-2] == row[2:]
    inside &= (b[:-2] != 0x20) | (b[1:-1] != 0x20)
    inside &= (b[2:] != 0x20) | (b[1:-1] != 0x20)
    at = row[:-2][inside] * dims + cell[inside]
    return np.bincount(at, minlength=n * dims).astype(np.float32).reshape(n, dims)


def _blocks(col: pa.Array, dims: int) -> Iterator[np.ndarray]:
    raw, offsets = text_bytes(col)
    for lo, hi in row_blocks(offsets):
        for at in range(lo, hi, 256):
            end = min(at + 256, hi)
            yield trigram_counts(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], dims)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, out=counts)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k unit centroids of unit rows; starts are the rows farthest from those before."""
    start = x.mean(axis=0)
    picks = [int(np.argmax(x @ start))]
    nearest = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picks[-1]])
    centre = x[picks].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            total = x[own == j].sum(axis=0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centre[j] = total / norm
    return centre


def windows(text: str) -> Iterator[str]:
    """The text, and for each power of two one run of that many words, from a place its length decides."""
    yield text
    words, n = text.split(), 1
    while n < len(words):
        at = len(text) * 2654435761 % (len(words) - n + 1)
        yield " ".join(words[at : at + n])
        n *= 2


def band_of(counts: np.ndarray, bands: int) -> np.ndarray:
    """Band of each row of trigram counts: 0 for 1 different trigram, 1 for 2-3, 2 for 4-7, ..."""
    different = np.maximum(np.count_nonzero(counts, axis=1), 1)
    return np.minimum(np.log2(different).astype(np.int64), bands - 1)


def floors(cosine: np.ndarray, band: np.ndarray, settings: Settings) -> list[float]:
    """Least cosine by band; a band of few members has the floor of the one below, whose texts are shorter."""
    out, last = [], 0.0
    for k in range(settings.bands):
        own = cosine[band == k]
        if len(own) >= settings.least_members:
            last = max(last, settings.reject * float(np.quantile(own, settings.quantile)))
        out.append(last)
    return out


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray  # by centroid and band


def fit(train: DataFrame, settings: Settings) -> Model | None:
    """Model of labelled rows (doc_id, text, lang); None without any.

    What reaches the driver is `dims` document frequencies and `clusters`
    centroids per language.
    """
    spark, dims = train.sparkSession, settings.dims
    ship(spark)
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    counted = schema(cell=INT, n=LONG)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for batch in batches:
            for counts in _blocks(batch.column("text"), dims):
                total += np.count_nonzero(counts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=counted.names)

    frequency = np.zeros(dims)
    for r in train.select("text").mapInArrow(frequencies, counted).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        frequency[r["cell"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)).astype(np.float32) + np.float32(1)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, settings.fit_rows / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.where(draw < share[F.col("lang")])
    found = schema(lang=STR, centroid=STR, least=STR)

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        texts = group["text"].tolist()
        x = np.concatenate([_vectors(c, idf) for c in _blocks(pa.array(texts, pa.string()), dims)])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c = cluster(x, settings.clusters, settings.rounds)
        cosine, band = [], []
        for lo in range(0, len(texts), 64):
            for counts in _blocks(pa.array([w for t in texts[lo : lo + 64] for w in windows(t)], pa.string()), dims):
                counts = counts[counts.any(axis=1)]
                band.append(band_of(counts, settings.bands))
                cosine.append((_vectors(counts, idf) @ c.T).max(axis=1))
        least = np.array(floors(np.concatenate(cosine), np.concatenate(band), settings), "<f8").tobytes().hex()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes().hex() for v in c], "least": least})

    rows = sorted(sample.groupBy("lang").applyInPandas(centroids, found).collect())
    if not rows:
        return None
    return Model(idf, [r["lang"] for r in rows], np.array([np.frombuffer(bytes.fromhex(r["centroid"]), "<f4") for r in rows]), np.array([np.frombuffer(bytes.fromhex(r["least"]), "<f8") for r in rows]))


PREDICTED = schema(doc_id=LONG, lang_pred=STR, score=DBL, rejected=BOOL, digest=LONG)


def identify(docs: DataFrame, train: Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected of every row, learned from the rows where `train` holds."""
    return _predicted(docs, train, settings, id_col, text_col, lang_col).drop("digest")


def _predicted(docs: DataFrame, train: Column, settings: Settings | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The same with xxhash64 of the text, which tells rows of one id apart."""
    settings = settings or Settings()
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = docs.where(train).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), settings)
    lettered = rows.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).withColumn("digest", F.xxhash64("text"))
    if model is None:
        return lettered.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), "digest")
    shared = spark.sparkContext.broadcast(model)  # dims * (1 + clusters * languages) floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, object)
        for batch in batches:
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            if not len(letter):
                continue
            best, score, near = [], [], []
            for counts in _blocks(batch.column("text"), settings.dims):
                band = band_of(counts, settings.bands)
                cosine = _vectors(counts, m.idf) @ m.centroids.T
                top = np.argmax(cosine, axis=1)
                best.append(top)
                score.append(cosine[np.arange(len(top)), top])
                near.append((score[-1] >= m.least[top, band]) & (score[-1] > 0))
            top, value, within = np.concatenate(best), np.concatenate(score), np.concatenate(near)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.where(letter, names[top], UNKNOWN), pa.string()),
                    pa.array(np.where(letter, np.clip(value, 0, 1), 0.0).astype(np.float64)),
                    pa.array(~(letter & within)),
                    batch.column("digest"),
                ],
                names=PREDICTED.names,
            )

    return lettered.mapInArrow(predict, PREDICTED)


def training_fold(id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """True for rows outside the held-out fold of crc32(id as text)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out, F.lit(True))


def drop_unidentified(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the rows that language identification rejects."""
    found = _predicted(docs, training_fold(id_col), settings, id_col, text_col, lang_col).where("rejected")
    return without_rows(docs, found.select("doc_id", "digest", F.lit(False).alias("once")), F.xxhash64(F.col(text_col).cast("string")), id_col)
