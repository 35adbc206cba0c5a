"""Structured Streaming: event windows, sessions, dedup, stub filling and gated recurrent state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_messages(events: DataFrame, *keys: str) -> DataFrame:
    """Each key once, however late its rows come; without a watermark, so a stream's state keeps every key."""
    return events.dropDuplicates(list(keys))


_FOLDED = "part int, user_id long, event_id long, at long, state double, run boolean"


def recurrent_state(events: DataFrame, gate: float = 0.3, forget: float = 0.99, ring: int = 8) -> DataFrame:
    """user_id, event_id, state and slots: per user s' = g x + (1 - g) f s over events by (ts, event_id), with a ring of the last ids.

    Events are cut into ranges of (user, ts, id), so a user of any number of events is
    several blocks.  Each is folded from state 0; a block that goes on with the user before
    adds that user's state times ((1 - g) f)^i to its i-th event.  Two rows a block reach
    the driver.  A null value makes the state null from there on.
    """
    keep = (1 - gate) * forget
    order = ["user_id", "ts", "event_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, user, at, value, runs = TaskContext.get().partitionId(), None, 0, 0.0, 0
        names = ["part", "user_id", "event_id", "at", "state", "run"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for u, i, x in zip(*(batch.column(c).to_pylist() for c in ("user_id", "event_id", "value")), strict=True):
                if not runs or u != user:
                    if runs == 1:
                        out.append((part, user, None, at, value, True))
                    user, at, value, runs = u, 0, 0.0, runs + 1
                value = None if x is None or value is None else gate * x + keep * value
                at += 1
                out.append((part, u, i, at, value, False))
            if out:
                yield table(out)
        if runs:
            yield table([(part, user, None, at, value, True)])

    ranged = events.select("user_id", "event_id", "ts", "value").repartitionByRange(*order).sortWithinPartitions(*order)
    folded = materialised(ranged.mapInArrow(fold, _FOLDED))
    runs: dict[int, list] = {}
    for r in folded.where("run").collect():  # the first and the last user of each block
        runs.setdefault(r["part"], []).append(r)
    entering, user, value, count = [], None, 0.0, 0
    for part in sorted(runs):
        for r in sorted(runs[part], key=lambda r: (r["user_id"] is not None, r["user_id"] or 0)):
            if count and r["user_id"] == user:
                entering.append((part, user, value, count))
                value = None if value is None or r["state"] is None else r["state"] + keep ** r["at"] * value
                count += r["at"]
            else:
                user, value, count = r["user_id"], r["state"], r["at"]
    before = events.sparkSession.createDataFrame(entering, "_part int, _user long, _state double, _count long")
    rows = folded.where("NOT run").join(F.broadcast(before), (F.col("part") == F.col("_part")) & F.col("user_id").eqNullSafe(F.col("_user")), "left")
    state = F.when(F.col("_count").isNull(), F.col("state")).otherwise(F.col("state") + F.pow(F.lit(keep), F.col("at")) * F.col("_state"))
    slots = F.least(F.col("at") + F.coalesce("_count", F.lit(0)), F.lit(ring)).cast("int")
    return rows.select("user_id", "event_id", state.alias("state"), slots.alias("slots"))


def fill_stubs(stubs: DataFrame, extract, episodes_path: str, edges_path: str, checkpoint: str):
    """Write episode stubs as they come and their edges once extracted; each batch has its own folder, which a retried batch writes anew."""

    def fill(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{episodes_path}/batch={number}")
        extract(batch).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")

    return stubs.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
