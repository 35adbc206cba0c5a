"""Shared-folder tables, shipping of this package to executors, and small column helpers.

Lineage is cut with tables written under the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (local tests) a folder of
the driver's own is made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_own: dict[str, str] = {}


#: Bytes of an Arrow batch between the JVM and a worker, where the session has Spark's default.
ARROW_BATCH, _DEFAULT_BATCH = "4m", ("67108864b", "64MB", "64m")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Whole texts pass through Arrow, so batches are bounded by bytes: the session's own
    bound is kept, Spark's default is lowered.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in _DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="memlattice-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from the session; else one of the driver's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="memlattice-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = f"file://{folder}"
        base = _own[app]
    return base.rstrip("/") + "/memlattice"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: lineage is cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one step, which are removed together once the step's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "step")

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, url: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def posix_path(url: str) -> str:
    """The mounted path of a shared folder; only file: URLs and plain paths have one."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"{url} is not on a mounted file system; name a mounted model_dir")
    return os.path.abspath(url)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that `written` left in this session's shared folder."""
    remove(spark, shared_root(spark))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table of documents; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Bytes that one partition of an explicit repartition is to hold.
PARTITION_BYTES = 64 << 20


def partitions_for(df: DataFrame, growth: float = 1.0) -> int:
    """Partitions for an explicit repartition: the session's number, or more for large tables.

    The size is what the plan's tables hold, times `growth` where rows are multiplied
    on the way; nothing is run to find it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    known = min(size, 1 << 60)  # tables without statistics claim more
    wanted = int(known * growth) // PARTITION_BYTES if known < 1 << 55 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 200_000))


LONG, INT, STR, BIN, BOOL, DBL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.BooleanType(), T.DoubleType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
