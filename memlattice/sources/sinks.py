"""Writers, resumable sinks and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of the driver's own only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base and app not in _own:
        folder = tempfile.mkdtemp(prefix="memlattice-tables-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return base or _own[app]


def materialised(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so its lineage ends there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/graph-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log table partitioned by day."""
    df.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").parquet(path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a resumed run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def compacted(df: DataFrame, key: str, path: str, files: int) -> DataFrame:
    """Rewrite a table in key order into `files` files; returns what is there now."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
