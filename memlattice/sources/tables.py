"""The memory model bound to the driver tables, and the same bindings in SQL.

* episodes: a user turn of `conversations` and the assistant turn after it;
* edges: (s, p, o) triples of episodes, `document_edges` of documents;
* sections: paragraphs of `documents`;
* assertions and retrievals: `events` by user;
* vectors: `embeddings`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlattice.functions import text as X
from memlattice.sources.sinks import shared_folder

#: Tone words of the binding, longest part first seen.
EPOCH = "2026-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files per partition that `dealt` makes, and the least partitions.
PART_BYTES, LEAST_PARTS = 8 << 20, 12
#: Shuffled bytes of a task that writes a derived table; its rows are sorted by the partition column in memory.
WRITE_BYTES = "8m"
#: Parts of a value's rows that each sending task deals apart.
SALTS = 16
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

_known: dict[tuple[str, ...], tuple[str, StructType]] = {}


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, as the file system lists them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(where)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def n_parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions in proportion to a table's files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(LEAST_PARTS, -(-sum(f.getLen() for f in system.listStatus(where)) // PART_BYTES))


def dealt(df: DataFrame, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """`df` dealt by keys into partitions in proportion to the table it comes from, which adaptive execution does not coalesce.

    So the rows a task sorts or counts stay the same while the table grows, whatever the session advises.
    """
    return df.repartition(n_parts(df.sparkSession, sf_dir, name), *keys)


@contextmanager
def _small_writes(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ADVISED)
    spark.conf.set(_ADVISED, WRITE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_ADVISED, before)


def salted(df: DataFrame, partition: str) -> DataFrame:
    """`df` rebalanced by the partition column and a hash of the row.

    Adaptive execution splits what one value has too much of between the tasks that sent it, but never what one of them
    sent, which grows with the file parts that it reads; so that is cut in `SALTS`.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    return df.withColumn("_salt", salt).hint("rebalance", F.col(partition), F.col("_salt")).drop("_salt")


def stored(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """A derived table, written once per application and state of its source tables and read from then on."""
    marks = [fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in sources]
    key = (spark.sparkContext.applicationId, sf_dir, name, *marks)
    if key not in _known:
        df, path = build(), f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        writer = salted(df, partition).write.partitionBy(partition) if partition else df.write
        with _small_writes(spark):
            writer.parquet(path)
        _known[key] = path, df.schema
    path, schema = _known[key]
    return spark.read.schema(schema).parquet(path)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored exchanges; see `derived_episodes`."""
    return stored(spark, sf_dir, "episodes", ["conversations"], lambda: derived_episodes(spark, sf_dir))


def derived_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exchange: id, session, user, ts, prompt, reply, summary, entities, topics, tones, follows."""
    turns = table(spark, sf_dir, "conversations")
    session = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("_role", F.lead("role").over(session)).withColumn("reply", F.lead("text").over(session))
    rows = paired.where("role = 'user' AND _role = 'assistant'").select(
        F.format_string("ep_%06d_%03d", "conv_id", "turn").alias("id"),
        F.concat(F.lit("S:"), F.col("conv_id").cast("string")).alias("session"),
        F.concat(F.lit("U:"), (F.col("conv_id") % 40).cast("string")).alias("user"),
        F.expr(f"timestamp_seconds(unix_seconds(timestamp'{EPOCH}') + conv_id * 5400 + turn * 60)").alias("ts"),
        "conv_id",
        "turn",
        F.col("text").alias("prompt"),
        "reply",
    )
    body = F.concat_ws(" ", "prompt", "reply")
    words = F.regexp_extract_all(F.lower(body), F.lit("([a-z]{10,})"), F.lit(1))
    return rows.select(
        "*",
        F.substring("reply", 1, 200).alias("summary"),
        X.capitalised(body, 6).alias("entities"),
        F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 5))).alias("topics"),
        F.filter(
            F.array(F.when(F.length("reply") > 1500, "expansive"), F.when(F.length("prompt") < 200, "terse"), F.when(body.contains("|"), "tabular")),
            lambda t: t.isNotNull(),
        ).alias("tones"),
        F.lag("id").over(session).alias("follows"),
    )


EPISODES_SQL = f"""
    turns AS (
        SELECT *, lead(role) OVER s AS next_role, lead(text) OVER s AS reply FROM conversations WINDOW s AS (PARTITION BY conv_id ORDER BY turn)
    ), pairs AS (
        SELECT printf('ep_%06d_%03d', conv_id, turn) AS id, 'S:' || conv_id AS session, 'U:' || (conv_id % 40) AS "user",
               TIMESTAMP '{EPOCH}' + to_seconds(conv_id * 5400 + turn * 60) AS ts, conv_id, turn, text AS prompt, reply,
               concat_ws(' ', text, reply) AS body
        FROM turns WHERE role = 'user' AND next_role = 'assistant'
    ), episodes AS (
        SELECT *, substr(reply, 1, 200) AS summary,
               list_distinct(regexp_extract_all(body, '[A-Z][a-z]{{5,}}')) AS entities,
               list_distinct(list_transform(regexp_extract_all(lower(body), '[a-z]{{10,}}'), lambda w: substr(w, 1, 5))) AS topics,
               list_filter([CASE WHEN length(reply) > 1500 THEN 'expansive' END, CASE WHEN length(prompt) < 200 THEN 'terse' END,
                            CASE WHEN contains(body, '|') THEN 'tabular' END], lambda t: t IS NOT NULL) AS tones,
               lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS follows
        FROM pairs
    )"""


def episode_edges(eps: DataFrame) -> DataFrame:
    """Triples of episodes: one per axis value, reverse entity edges, follows and session scope."""

    def axis(column: str, predicate: str, prefix: str) -> DataFrame:
        return eps.select(F.col("id").alias("s"), F.lit(predicate).alias("p"), F.explode(column).alias("_v")).select("s", "p", F.concat(F.lit(prefix), "_v").alias("o"))

    entity = axis("entities", "has_entity", "E:")
    parts = [
        entity,
        entity.select(F.col("o").alias("s"), F.lit("in_episode").alias("p"), F.col("s").alias("o")),
        axis("topics", "has_topic", "T:"),
        axis("tones", "has_tone", "A:"),
        eps.where("follows IS NOT NULL").select(F.col("id").alias("s"), F.lit("follows").alias("p"), F.col("follows").alias("o")),
        eps.select(F.col("id").alias("s"), F.lit("in_session").alias("p"), F.col("session").alias("o")),
        eps.select(F.col("user").alias("s"), F.lit("has_session").alias("p"), F.col("session").alias("o")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


EDGES_SQL = EPISODES_SQL + """, edges AS (
        SELECT id AS s, 'has_entity' AS p, 'E:' || unnest(entities) AS o FROM episodes
        UNION ALL SELECT 'E:' || unnest(entities), 'in_episode', id FROM episodes
        UNION ALL SELECT id, 'has_topic', 'T:' || unnest(topics) FROM episodes
        UNION ALL SELECT id, 'has_tone', 'A:' || unnest(tones) FROM episodes
        UNION ALL SELECT id, 'follows', follows FROM episodes WHERE follows IS NOT NULL
        UNION ALL SELECT id, 'in_session', session FROM episodes
        UNION ALL SELECT DISTINCT "user", 'has_session', session FROM episodes
    )"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored triples; a filter on p reads that predicate's files only."""
    return stored(spark, sf_dir, "edges", ["conversations"], lambda: episode_edges(episodes(spark, sf_dir)), "p").select("s", "p", "o")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections: doc, idx, section id, body, hash."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("_pos", "body")).where(F.trim("body") != "")
    return lines.select(
        F.format_string("doc_%06d", "doc_id").alias("doc"),
        "source",
        F.col("_pos").cast("long").alias("idx"),
        F.format_string("doc_%06d_sec_%03d", F.col("doc_id"), F.col("_pos")).alias("section"),
        "body",
        X.content_hash(F.col("body")).alias("blob_hash"),
    )


SECTIONS_SQL = """
    lines AS (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents
    ), sections AS (
        SELECT printf('doc_%06d', doc_id) AS doc, source, idx, printf('doc_%06d_sec_%03d', doc_id, idx) AS section, body, substr(sha256(body), 1, 16) AS blob_hash
        FROM lines WHERE trim(body, ' ') <> ''
    )"""


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of documents and their sections: structure, source, kind, and entities of section texts."""

    def build() -> DataFrame:
        s = sections(spark, sf_dir)
        named = s.select("section", F.explode(X.capitalised(F.col("body"), 6)).alias("_v")).select(F.col("section").alias("s"), F.lit("has_entity").alias("p"), F.concat(F.lit("E:"), "_v").alias("o"))
        docs = table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", "doc_id").alias("doc"), "source", "lang")
        parts = [
            s.select(F.col("section").alias("s"), F.lit("child_of").alias("p"), F.col("doc").alias("o")),
            s.select(F.col("doc").alias("s"), F.lit("has_section").alias("p"), F.col("section").alias("o")),
            docs.where("source IS NOT NULL").select(F.col("doc").alias("s"), F.lit("from_source").alias("p"), F.concat(F.lit("src:"), "source").alias("o")),
            docs.where("lang IS NOT NULL").select(F.col("doc").alias("s"), F.lit("of_kind").alias("p"), F.concat(F.lit("K:"), "lang").alias("o")),
            named.select(F.col("o").alias("s"), F.lit("in_section").alias("p"), F.col("s").alias("o")),
        ]
        for part in parts:
            named = named.unionByName(part)
        return named

    return stored(spark, sf_dir, "document_edges", ["documents"], build, "p").select("s", "p", "o")


DOCUMENT_EDGES_SQL = SECTIONS_SQL + """, document_edges AS (
        SELECT section AS s, 'child_of' AS p, doc AS o FROM sections
        UNION ALL SELECT doc, 'has_section', section FROM sections
        UNION ALL SELECT printf('doc_%06d', doc_id), 'from_source', 'src:' || source FROM documents WHERE source IS NOT NULL
        UNION ALL SELECT printf('doc_%06d', doc_id), 'of_kind', 'K:' || lang FROM documents WHERE lang IS NOT NULL
        UNION ALL SELECT section, 'has_entity', 'E:' || unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{5,}'))) FROM sections
        UNION ALL SELECT 'E:' || unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{5,}'))), 'in_section', section FROM sections
    )"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State assertions (entity, value, asserted_by, asserted_at) from events."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U:"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("value"),
        F.col("event_id").alias("asserted_by"),
        F.col("ts").cast("timestamp").alias("asserted_at"),
    )


ASSERTIONS_SQL = """
    assertions AS (
        SELECT 'U:' || user_id AS entity, event_type AS value, event_id AS asserted_by, ts AS asserted_at FROM events
    )"""
