"""Entity x class candidates: the nearest classes in blocks of both sides, and a slice of classes that moves on with every run."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.operators.evaluation import placed_values
from memlattice.sources.sinks import shared_folder

#: Rows of a block on either side.
BLOCK_ROWS = 4096


def nearest_classes(entities: DataFrame, classes: DataFrame, k: int, block_rows: int = BLOCK_ROWS, digits: int = 6) -> DataFrame:
    """(entity, class, score, rank): the k classes of highest dot product for each entity.

    Both sides (entity, vector) and (class, vector) may be large: they are dealt into blocks by a hash of their ids, and
    every pair of blocks is one task's product of two matrices, of which each entity keeps k.  So an entity is
    shuffled once per block of classes and a class once per block of entities, and k rows per entity and block of
    classes are ranked.  Scores are rounded, and equal ones go by class, so the result does not depend on the blocks.

    Defined results: null ids and vectors, and vectors of another length than most, raise no error: nulls are left out, and a
    vector meets those of its own length only; repeated ids are rows of their own; an empty side gives no rows.
    """
    id_e, id_c = entities.schema["entity"].dataType, classes.schema["class"].dataType
    e = entities.where("entity IS NOT NULL AND vector IS NOT NULL").select("entity", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    c = classes.where("class IS NOT NULL AND vector IS NOT NULL").select("class", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    rows, columns = (max(1, -(-df.count() // block_rows)) for df in (e, c))
    # both sides' block numbers are of one type: a cogroup casts no keys, and an int is dealt elsewhere than an equal long
    left = e.withColumn("i", F.pmod(F.xxhash64("entity"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = c.withColumn("jj", F.pmod(F.xxhash64("class"), F.lit(columns)).cast("int")).withColumn("ii", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumnRenamed("dim", "d")
    out = T.StructType([T.StructField("entity", id_e), T.StructField("class", id_c), T.StructField("score", T.DoubleType())])

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1)

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"entity": a["entity"].slice(0, 0), "class": b["class"].slice(0, 0), "score": pa.array([], pa.float64())})
        b = b.sort_by("class")  # equal scores: the first class is taken
        scores = np.round(matrix(a) @ matrix(b).T, digits) + 0.0
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        who = np.repeat(np.arange(a.num_rows), best.shape[1])
        return pa.table({"entity": a["entity"].take(pa.array(who)), "class": b["class"].take(pa.array(best.ravel())), "score": np.take_along_axis(scores, best, 1).ravel()})

    met = left.groupBy("i", "j", "dim").cogroup(right.groupBy("ii", "jj", "d")).applyInArrow(product, out)
    nth = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "class"))
    return met.withColumn("rank", nth).where(F.col("rank") <= k)


def new_folder(spark: SparkSession) -> str:
    """A folder for a rotation's state in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/rotation-{uuid.uuid4().hex[:12]}"


def next_slice(classes: DataFrame, size: int, folder: str) -> DataFrame:
    """(class): the next `size` classes in order of names, from where the run before ended; the list is a circle.

    The state is a table of one row per run under `folder`: the last class of its slice.  A run goes on
    after that name, so classes that come or go between runs neither shift nor repeat the others.  Every class is taken within
    ceil(n / size) runs.  Two runs must not share a folder at the same time.
    """
    spark = classes.sparkSession
    ranked = placed_values(classes.select(F.lit(0).alias("_k"), F.col("class").cast("string").alias("class")).where("class IS NOT NULL").distinct(), "_k", "class")
    ranked = ranked.select("class", "before", "total")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    runs = spark.read.parquet(folder) if known else spark.createDataFrame([], "run long, last string")
    newest = runs.orderBy(F.desc("run")).limit(1).collect()
    last, run = (newest[0]["last"], newest[0]["run"]) if newest else (None, -1)
    begin = ranked.where(F.col("class") <= last).count() if last is not None else 0
    place = F.pmod(F.col("before") - F.lit(begin), F.col("total"))
    taken = ranked.where(place < size).select("class", place.alias("_place"))
    end = taken.orderBy(F.desc("_place")).limit(1).collect()
    if end:
        spark.createDataFrame([(run + 1, end[0]["class"])], "run long, last string").write.mode("append").parquet(folder)
    return taken.select("class")


def rotated(classes: DataFrame, size: int, folder: str, runs: int) -> DataFrame:
    """(run, class): the slices of some runs one after another."""
    out = None
    for run in range(runs):
        part = next_slice(classes, size, folder).select(F.lit(run).alias("run"), "class")
        out = part if out is None else out.unionByName(part)
    return out
