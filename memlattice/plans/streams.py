"""Streaming queries, run over the events there are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.registry import query
from memlattice.sources import tables as T
from memlattice.sources.sinks import shared_folder
from memlattice.streaming import freshness as Z
from memlattice.streaming import pipelines as P

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file source takes folders and globs
    stream = P.event_stream(spark, f"{sf_dir}/events.parquet*", _SCHEMA, 64)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _written(stream: DataFrame, mode: str, name: str, base: str | None = None) -> DataFrame:
    """The stream's rows, through a table in the shared folder."""
    spark, base = stream.sparkSession, base or _folder(stream.sparkSession, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={0 if mode == 'complete' else n}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(fields).parquet(f"{base}/rows").select(*stream.columns)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the event stream, complete at its end."""
    g = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = _written(g.select(F.col("_w.start").alias("start"), "event_type", "n", "total"), "complete", "daily")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each over all batches; the table that batches append to is the state."""
    rows = _written(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "append", "distinct")
    return P.distinct_messages(rows, "event_id", "user_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, 0.3::DOUBLE * value AS state FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_id, e.i, 0.3::DOUBLE * e.value + 0.7::DOUBLE * 0.99::DOUBLE * f.state FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id, round(state, 4) AS state, least(i, 8)::INTEGER AS slots FROM f""")
def stream_recurrent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated state and ring of every user over the stream, in the order of time, not of files."""
    rows = P.recurrent_state(_written(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "append", "state"))
    return rows.select("user_id", "event_id", F.round("state", 4).alias("state"), "slots")


#: Each turn touches the capitalised words of its text; what is found for a word are the documents whose lines name it.
_SIGNALS_SQL = """
    WITH RECURSIVE named AS (
        SELECT 'S:' || conv_id AS session, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS source, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{5,}'), 1) AS pos FROM conversations
    ), touched AS (
        SELECT session, turn, source, row_number() OVER (PARTITION BY session ORDER BY turn, min(pos)) - 1 AS slot FROM named GROUP BY session, turn, source
    ), found AS (
        SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS source FROM documents
    ), placed AS (
        SELECT *, min(slot) OVER (PARTITION BY session, turn) AS f, lag(slot) OVER (PARTITION BY session, source ORDER BY slot) AS before FROM touched
    ), aged AS (
        SELECT session, turn, source, slot AS number, turn - max(CASE WHEN before IS NULL OR before < f - 8 THEN turn END) OVER (PARTITION BY session, source ORDER BY slot) AS age FROM placed
    ), signals AS (
        SELECT session, turn, aged.source, CASE WHEN found.source IS NOT NULL THEN 'recall' WHEN age < 3 THEN 'stale_uncertain' ELSE 'dropped' END AS kind, age, number FROM aged LEFT JOIN found USING (source)
    )"""


def turn_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the sources they touch and the documents found for each, as `freshness.TURNS`."""
    turns = T.table(spark, sf_dir, "conversations").select(F.concat(F.lit("S:"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").cast("long").alias("turn"), X.capitalised(F.col("text"), 6).alias("_s"))
    named = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.capitalised(F.col("text"), 6)).alias("source"))
    found = named.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    each = turns.select("session", "turn", F.posexplode_outer("_s").alias("_p", "source")).join(found, "source", "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("_p", "source", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))))
    return each.groupBy("session", "turn").agg(rows.alias("_r")).select("session", "turn", F.transform("_r", lambda x: x["source"]).alias("sources"), F.transform("_r", lambda x: x["hits"]).alias("hits"))


def _freshness(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The signals of the conversations' stream, and the stream's folder."""
    Z.with_state_store(spark)
    base = _folder(spark, "freshness")
    turn_sources(spark, sf_dir).write.parquet(f"{base}/turns")
    stream = P.event_stream(spark, f"{base}/turns", Z.TURNS, 64)
    return _written(Z.freshness_signals(stream), "append", "freshness", base), base


@query(_SIGNALS_SQL + " SELECT session, turn, source, kind, age, number FROM signals")
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of the sources of every turn: recall, stale and uncertain, or dropped."""
    return _freshness(spark, sf_dir)[0]


@query(_SIGNALS_SQL + " SELECT session, number, source, kind FROM (SELECT *, max(number) OVER (PARTITION BY session) AS newest FROM signals) WHERE number > newest - 1000")
def stream_signal_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 1,000 signals of every session, read from the stream's state."""
    return Z.buffered_signals(spark, f"{_freshness(spark, sf_dir)[1]}/checkpoint").select("session", "number", "source", "kind")
