"""Visibility of units, documents in the graph, deletion, hydration and context blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.operators import units as U
from memlattice.registry import query
from memlattice.sources import tables as T

_STATES_SQL = T.EPISODES_SQL + """, units AS (
        SELECT id, session, "user", ts, turn, summary, prompt, reply, entities, topics,
               CASE WHEN conv_id % 7 = 3 THEN 'superseded' WHEN conv_id % 11 <> 4 THEN 'current' END AS state,
               CASE WHEN conv_id % 5 = 2 THEN ts + INTERVAL 1 DAY END AS validity_end, turn % 4 = 2 AS abstracted FROM episodes
    ), active AS (SELECT * FROM units WHERE NOT abstracted AND coalesce(state, 'current') = 'current' AND validity_end IS NULL)"""


def _deal(sf_dir: str) -> Callable[..., DataFrame]:
    """Deals edges of documents by keys."""
    return lambda df, *keys: T.dealt(df, sf_dir, "documents", *keys)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with their state, validity and abstraction flag."""
    state = F.when(F.col("conv_id") % 7 == 3, "superseded").when(F.col("conv_id") % 11 != 4, "current")
    until = F.when(F.col("conv_id") % 5 == 2, F.expr("ts + INTERVAL 1 DAY"))
    return T.episodes(spark, sf_dir).withColumn("state", state).withColumn("validity_end", until).withColumn("abstracted", F.col("turn") % 4 == 2)


@query("WITH " + _STATES_SQL + " SELECT id, session, ts FROM active")
def active_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes shown by default."""
    return U.visible(units(spark, sf_dir)).select("id", "session", "ts")


@query("WITH " + _STATES_SQL + """, found AS (SELECT id FROM units UNION ALL SELECT printf('doc_%06d', doc_id) FROM documents UNION ALL SELECT 'M:' || session FROM units GROUP BY session UNION ALL SELECT 'ep_unknown')
    SELECT id FROM found WHERE id LIKE 'doc\\_%' ESCAPE '\\' OR id LIKE 'M:%' OR id NOT IN (SELECT id FROM units WHERE NOT (coalesce(state, 'current') = 'current' AND validity_end IS NULL))""")
def active_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without superseded or expired episodes; documents, memories and unknown ids pass."""
    u = units(spark, sf_dir)
    found = u.select("id").unionByName(T.table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", "doc_id").alias("id")))
    found = found.unionByName(u.select(F.concat(F.lit("M:"), "session").alias("id")).distinct()).unionByName(spark.createDataFrame([("ep_unknown",)], "id string"))
    return U.visible_candidates(found, u)


@query("WITH " + _STATES_SQL + """, timed AS (SELECT id, ts FROM units UNION ALL SELECT printf('doc_%06d', doc_id), TIMESTAMP '2026-07-01 00:00:00' + to_seconds(doc_id * 60) FROM documents WHERE source IS NOT NULL)
    SELECT id, ts FROM timed WHERE ts >= TIMESTAMP '2026-07-02 00:00:00' AND ts <= TIMESTAMP '2026-07-03 00:00:00'""")
def candidate_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by their time and documents by the time they were ingested, in one range."""
    docs = T.table(spark, sf_dir, "documents").where("source IS NOT NULL")
    taken = F.expr(f"timestamp_seconds(unix_seconds(timestamp'{T.EPOCH}') + doc_id * 60)")
    both = units(spark, sf_dir).select("id", "ts").unionByName(docs.select(F.format_string("doc_%06d", "doc_id").alias("id"), taken.alias("ts")))
    return both.where("ts >= timestamp'2026-07-02 00:00:00' AND ts <= timestamp'2026-07-03 00:00:00'")


@query("WITH " + T.DOCUMENT_EDGES_SQL + " SELECT p, count(*) AS n_edges, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM document_edges GROUP BY p")
def document_edges_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple expansion of documents: both ends of a triple are dealt by their node, each node is one row, and these are counted."""
    ends = T.document_edges(spark, sf_dir).select("p", F.inline(F.array(F.struct(F.lit(True).alias("subject"), F.col("s").alias("node")), F.struct(F.lit(False).alias("subject"), F.col("o").alias("node")))))
    nodes = _deal(sf_dir)(ends, "p", "subject", "node").groupBy("p", "subject", "node").agg(F.count(F.lit(1)).alias("_n"))
    return nodes.groupBy("p").agg(F.sum(F.when(F.col("subject"), F.col("_n"))).alias("n_edges"), F.count(F.when(F.col("subject"), 1)).alias("n_subjects"), F.count(F.when(~F.col("subject"), 1)).alias("n_objects"))


@query("WITH " + T.SECTIONS_SQL + """, m AS (SELECT doc, count(*) AS n_sections, sum(length(body))::BIGINT AS n_chars, trim(regexp_replace(min_by(body, idx), '^#+ *', ''), ' ') AS title FROM sections GROUP BY doc)
    SELECT printf('doc_%06d', doc_id) AS doc, substr(title, 1, 80) AS title, source, lang AS kind, coalesce(n_sections, 0) AS n_sections, coalesce(m.n_chars, 0) AS n_chars FROM documents LEFT JOIN m ON m.doc = printf('doc_%06d', doc_id)""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every document, without bodies; the title is the first section's line."""
    s = T.sections(spark, sf_dir).groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("body")).alias("n_chars"), F.min_by("body", "idx").alias("_first")
    )
    docs = T.table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", "doc_id").alias("doc"), "source", F.col("lang").alias("kind"))
    title = F.substring(F.trim(F.regexp_replace("_first", "^#+ *", "")), 1, 80)
    return docs.join(s, "doc", "left").select("doc", title.alias("title"), "source", "kind", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("WITH " + T.SECTIONS_SQL + " SELECT doc, count(*) AS n_sections, sha256(string_agg(body, chr(10) ORDER BY idx)) AS body_sha256, count(DISTINCT blob_hash) AS n_blobs FROM sections GROUP BY doc")
def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bodies of documents, put together from their sections in order."""
    g = T.sections(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("_s"), F.countDistinct("blob_hash").alias("n_blobs"))
    body = F.array_join(F.transform("_s", lambda r: r["body"]), "\n")
    return g.select("doc", F.size("_s").cast("long").alias("n_sections"), F.sha2(body, 256).alias("body_sha256"), "n_blobs")


@query("WITH " + T.DOCUMENT_EDGES_SQL + """, pairs AS (SELECT a.s AS doc, a.o AS source, b.o AS kind FROM document_edges a LEFT JOIN document_edges b ON a.s = b.s AND b.p = 'of_kind' WHERE a.p = 'from_source')
    SELECT source, kind, count(*) AS n, min(doc) AS first_doc FROM pairs GROUP BY ALL""")
def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse lookup of documents by source and kind, with the first of each."""
    e = T.document_edges(spark, sf_dir)
    side = lambda p, name: _deal(sf_dir)(e.where(F.col("p") == p).select("s", F.col("o").alias(name)), "s")
    pairs = side("from_source", "source").join(side("of_kind", "kind"), "s", "left")
    return pairs.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_doc"))


@query("WITH " + T.DOCUMENT_EDGES_SQL + """, gone AS (SELECT DISTINCT printf('doc_%06d', doc_id) AS node FROM labels WHERE toxic = 1), nodes AS (SELECT node FROM gone UNION SELECT o FROM document_edges WHERE p = 'has_section' AND s IN (SELECT node FROM gone))
    SELECT p, count(*) AS n_before, count(*) FILTER (s NOT IN (SELECT node FROM nodes) AND o NOT IN (SELECT node FROM nodes)) AS n_after FROM document_edges GROUP BY p""")
def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before and after the toxic documents go with their sections."""
    e = T.document_edges(spark, sf_dir)
    gone = T.table(spark, sf_dir, "labels").where("toxic = 1").select(F.format_string("doc_%06d", "doc_id").alias("doc")).distinct()
    after = U.without_documents(e, gone).groupBy("p").agg(F.count(F.lit(1)).alias("n_after"))
    return e.groupBy("p").agg(F.count(F.lit(1)).alias("n_before")).join(after, "p", "left").select("p", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


@query("WITH " + T.SECTIONS_SQL + ", gone AS (SELECT DISTINCT printf('doc_%06d', doc_id) AS doc FROM labels WHERE toxic = 1) SELECT blob_hash, count(*) AS refs, count(*) FILTER (doc IN (SELECT doc FROM gone)) AS released FROM sections GROUP BY blob_hash HAVING count(*) FILTER (doc IN (SELECT doc FROM gone)) > 0")
def released_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that blobs lose when the toxic documents are deleted."""
    gone = T.table(spark, sf_dir, "labels").where("toxic = 1").select(F.format_string("doc_%06d", "doc_id").alias("doc"), F.lit(1).alias("_gone")).distinct()
    g = T.sections(spark, sf_dir).join(gone, "doc", "left").groupBy("blob_hash").agg(F.count(F.lit(1)).alias("refs"), F.count("_gone").alias("released"))
    return g.where("released > 0")


@query("WITH " + T.SECTIONS_SQL + " SELECT count(*) > 0 AS has_sections FROM (SELECT 1 FROM sections LIMIT 1)")
def has_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is any document section; one row is read."""
    return T.sections(spark, sf_dir).select("section").limit(1).agg((F.count(F.lit(1)) > 0).alias("has_sections"))


@query("WITH " + T.DOCUMENT_EDGES_SQL + ", found AS (SELECT DISTINCT a.o AS entity, b.o AS doc FROM document_edges a JOIN document_edges b ON a.s = b.s AND b.p = 'child_of' WHERE a.p = 'has_entity') SELECT entity, count(*) AS n_docs, min(doc) AS first_doc FROM found GROUP BY entity HAVING count(*) >= 2")
def documents_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per entity of any of their sections, for entities of two or more."""
    found = U.documents_by_object(T.document_edges(spark, sf_dir), "has_entity", _deal(sf_dir))
    return found.groupBy(F.col("o").alias("entity")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc")).where("n_docs >= 2")


@query("WITH " + T.DOCUMENT_EDGES_SQL + """, e AS (SELECT DISTINCT b.o AS doc, a.o AS entity FROM document_edges a JOIN document_edges b ON a.s = b.s AND b.p = 'child_of' WHERE a.p = 'has_entity'),
    g AS (SELECT doc, count(*) AS n_entities, min(entity) AS first_entity FROM e GROUP BY doc), n AS (SELECT s AS doc, count(*) AS n_sections FROM document_edges WHERE p = 'has_section' GROUP BY s)
    SELECT n.doc, n_sections, coalesce(n_entities, 0) AS n_entities, first_entity, k.o AS kind FROM n LEFT JOIN g ON g.doc = n.doc LEFT JOIN document_edges k ON k.s = n.doc AND k.p = 'of_kind'""")
def document_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sections, entities over all of them, and kind."""
    e = T.document_edges(spark, sf_dir)
    deal = _deal(sf_dir)
    n = deal(e.where("p = 'has_section'").select(F.col("s").alias("doc")), "doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n_sections"))
    named = U.documents_by_object(e, "has_entity", deal, ("doc",)).groupBy("doc").agg(F.count(F.lit(1)).alias("n_entities"), F.min("o").alias("first_entity"))
    kind = deal(e.where("p = 'of_kind'").select(F.col("s").alias("doc"), F.col("o").alias("kind")), "doc")
    return n.join(named, "doc", "left").join(kind, "doc", "left").select("doc", "n_sections", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "first_entity", "kind")


@query("WITH " + T.DOCUMENT_EDGES_SQL + """, e AS (SELECT s, count(*) AS n FROM document_edges WHERE p = 'has_entity' GROUP BY s)
    SELECT c.s AS section, c.o AS doc, coalesce(n, 0) AS n_entities, k.o AS kind, src.o AS source FROM document_edges c LEFT JOIN e ON e.s = c.s LEFT JOIN document_edges k ON k.s = c.o AND k.p = 'of_kind' LEFT JOIN document_edges src ON src.s = c.o AND src.p = 'from_source' WHERE c.p = 'child_of'""")
def section_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their parent document, its kind and source, and how many entities they name."""
    e = T.document_edges(spark, sf_dir)
    meta = lambda p, name: e.where(F.col("p") == p).select(F.col("s").alias("doc"), F.col("o").alias(name))
    n = e.where("p = 'has_entity'").groupBy(F.col("s").alias("section")).agg(F.count(F.lit(1)).alias("n_entities"))
    rows = e.where("p = 'child_of'").select(F.col("s").alias("section"), F.col("o").alias("doc"))
    rows = rows.join(n, "section", "left").join(meta("of_kind", "kind"), "doc", "left").join(meta("from_source", "source"), "doc", "left")
    return rows.select("section", "doc", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "kind", "source")


@query("WITH " + T.EDGES_SQL + " SELECT o AS session, min(s) AS \"user\", count(*) AS n FROM edges WHERE p = 'has_session' GROUP BY o")
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of each session, the first by id where there are several."""
    e = T.edges(spark, sf_dir).where("p = 'has_session'")
    return e.groupBy(F.col("o").alias("session")).agg(F.min("s").alias("user"), F.count(F.lit(1)).alias("n"))


@query("WITH " + _STATES_SQL + """, lexical AS (SELECT 'q' || (conv_id % 9) AS query_id, id FROM (SELECT *, substr(session, 3)::BIGINT AS conv_id FROM units) WHERE turn = 0), semantic AS (SELECT 'q' || (conv_id % 9) AS query_id, id FROM (SELECT *, substr(session, 3)::BIGINT AS conv_id FROM units) WHERE turn <= 2)
    SELECT query_id, id, false AS from_more FROM lexical UNION ALL SELECT query_id, id, true FROM semantic s WHERE NOT EXISTS (SELECT 1 FROM lexical l WHERE l.query_id = s.query_id AND l.id = s.id)""")
def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic hits follow graph hits, only those that are not there yet."""
    u = units(spark, sf_dir).select(F.concat(F.lit("q"), (F.col("conv_id") % 9).cast("string")).alias("query_id"), "id", "turn")
    return U.appended(u.where("turn = 0"), u.where("turn <= 2"), ["query_id", "id"], ["query_id", "id"])


@query("WITH " + _STATES_SQL + """, fired AS (SELECT id FROM units WHERE abstracted)
    SELECT session, id, id IN (SELECT id FROM fired) AS fired, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN id IN (SELECT id FROM fired) THEN 0 ELSE 1 END, turn, id) - 1 AS place FROM units""")
def fired_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working memory first: fired units before the rest, each in its own order."""
    u = units(spark, sf_dir)
    return U.prepended(u.select("session", "id", F.col("turn").alias("position")), u.where("abstracted").select("id"), "session")


@query("WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM d WHERE n = 1")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered dedup: the first record of each joined text."""
    d = T.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("_k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("WITH " + _STATES_SQL + """, b AS (SELECT session, id, ts, '## ' || id || chr(10) || 'User: ' || trim(substr(regexp_replace(prompt, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 120), ' ') || chr(10) || 'Assistant: ' || trim(substr(regexp_replace(reply, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 120), ' ') AS block FROM active WHERE length(prompt) > 0 AND length(reply) > 0),
    c AS (SELECT *, sum(length(block) // 4 + 1) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS used FROM b)
    SELECT session, string_agg(block, chr(10) || chr(10) ORDER BY ts, id) AS context, count(*) AS n FROM c WHERE used <= 150 GROUP BY session""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible episodes of each session as text blocks, up to the first that overflows the budget."""
    u = U.visible(units(spark, sf_dir)).where("length(prompt) > 0 AND length(reply) > 0")
    text = U.block(F.col("id"), [("User", U.fact_value(F.col("prompt"), 120)), ("Assistant", U.fact_value(F.col("reply"), 120))])
    rows = u.select("session", "id", "ts", text.alias("block"))
    w = Window.partitionBy("session").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("_used", F.sum(F.floor(F.length("block") / 4) + 1).over(w)).where("_used <= 150")
    g = kept.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "block"))).alias("_b"))
    return g.select("session", F.array_join(F.transform("_b", lambda r: r["block"]), "\n\n").alias("context"), F.size("_b").cast("long").alias("n"))


@query("WITH " + T.SECTIONS_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n FROM sections) SELECT doc, string_agg(substr(body, 1, 500), chr(10) ORDER BY idx) AS context FROM p WHERE n <= 5 GROUP BY doc")
def document_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five sections of a document, 500 characters each: the feature's own limits."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    s = T.sections(spark, sf_dir).withColumn("_n", nth).where("_n <= 5")
    g = s.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", F.substring("body", 1, 500).alias("body")))).alias("_s"))
    return g.select("doc", F.array_join(F.transform("_s", lambda r: r["body"]), "\n").alias("context"))


@query("WITH " + T.EPISODES_SQL + " SELECT count(*) AS episodes, sum(len(entities))::BIGINT AS entities, sum(len(topics))::BIGINT AS topics, sum(len(tones))::BIGINT AS tones, round(avg(len(entities)), 6) AS entities_per_episode FROM episodes")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per axis and their mean per episode."""
    total = lambda c: F.sum(F.size(c)).alias(c)
    return T.episodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("episodes"), total("entities"), total("topics"), total("tones"), F.round(F.avg(F.size("entities")), 6).alias("entities_per_episode"))


@query("WITH s AS (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' AND length(text) >= 40) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, length(text) AS n_chars FROM s")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's user turns of 40 characters or more, in order."""
    s = T.table(spark, sf_dir, "conversations").where("role = 'user' AND length(text) >= 40")
    return s.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("position"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, max(turn) AS self_slot, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def self_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of a session's own last message: the highest numeric suffix of its ids."""
    ids = T.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.concat_ws("#msg", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("slot"))
    return ids.groupBy("conv_id").agg(F.max(F.substring_index("slot", "#msg", -1).cast("long")).alias("self_slot"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS n FROM documents) WHERE n <= 10")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per language without replacement, in the order of a seeded hash (a sampling operator)."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id")
    return T.table(spark, sf_dir, "documents").withColumn("_n", F.row_number().over(w)).where("_n <= 10").select("doc_id", "lang")
