"""Ingestion queries: sections, blobs, parsing, chunking, HTML, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators import lifecycle as L
from memlattice.registry import query
from memlattice.sources import parsers as P
from memlattice.sources import tables as T

_S = "WITH " + T.SECTIONS_SQL


@query(_S + " SELECT doc, count(*) AS n_sections, sum(length(body))::BIGINT AS n_chars, count(DISTINCT blob_hash) AS n_blobs FROM sections GROUP BY doc")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, characters and distinct bodies per document."""
    s = T.sections(spark, sf_dir)
    return s.groupBy("doc").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("body")).alias("n_chars"), F.countDistinct("blob_hash").alias("n_blobs"))


@query(_S + " SELECT blob_hash, count(*) AS refs, min(body) AS body FROM sections GROUP BY blob_hash HAVING count(*) > 1")
def shared_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed bodies that several sections refer to."""
    s = T.sections(spark, sf_dir)
    return s.groupBy("blob_hash").agg(F.count(F.lit(1)).alias("refs"), F.min("body").alias("body")).where("refs > 1")


@query(_S + """, a AS (SELECT blob_hash, count(*) AS c FROM sections WHERE source <> 'src1' GROUP BY 1), b AS (SELECT blob_hash, count(*) AS c FROM sections WHERE source <> 'src2' GROUP BY 1)
    SELECT coalesce(a.blob_hash, b.blob_hash) AS blob_hash, coalesce(b.c, 0) - coalesce(a.c, 0) AS delta FROM a FULL JOIN b ON a.blob_hash = b.blob_hash WHERE coalesce(b.c, 0) <> coalesce(a.c, 0)""")
def blob_refcount_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference changes between two versions of a section table."""
    s = T.sections(spark, sf_dir)
    return L.refcount_delta(s.where("source <> 'src1'"), s.where("source <> 'src2'"))


@query(_S + " SELECT DISTINCT blob_hash FROM sections s WHERE source = 'src3' AND NOT EXISTS (SELECT 1 FROM sections t WHERE t.blob_hash = s.blob_hash AND t.source <> 'src3')")
def orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that nothing refers to once one source is deleted."""
    s = T.sections(spark, sf_dir)
    return s.where("source = 'src3'").select("blob_hash").distinct().join(s.where("source <> 'src3'").select("blob_hash"), "blob_hash", "left_anti")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS version, length(text) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, 'new', length(text) + 1 FROM documents WHERE source = 'src1'")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions of one source's documents replace the old ones."""
    d = T.table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.lit("old").alias("version"), F.length("text").cast("long").alias("n"))
    new = d.where("source = 'src1'").select("doc_id", F.lit("new").alias("version"), (F.length("text") + 1).cast("long").alias("n"))
    return L.upsert(old, new, "doc_id")


@query(_S + """, p AS (SELECT doc, idx, body, greatest(1, length(body) // 4) AS tokens, sum(greatest(1, length(body) // 4)) OVER (PARTITION BY doc ORDER BY idx) AS total FROM sections)
    SELECT doc, CAST((total - 1) // 512 AS BIGINT) AS window, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM p GROUP BY ALL""")
def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by 512-token window of their document."""
    s = T.sections(spark, sf_dir).select("doc", "idx", X.token_estimate(F.col("body"), 1).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("doc").orderBy("idx"))
    return s.withColumn("window", F.floor((total - 1) / 512)).groupBy("doc", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query()
def html_page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page by its headings."""
    return P.html_sections(T.table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages."""
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed field of JSON text; null where it does not parse."""
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '^(html|htm)$') THEN 'html' ELSE 'text' END AS kind FROM pages".replace("\\\\", "\\"))
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File kind by extension."""
    p = T.table(spark, sf_dir, "pages")
    kind = P.file_kind(F.col("url"))
    return p.select("page_id", F.when(kind == "html", "html").otherwise("text").alias("kind"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
    SELECT conv_id, run::BIGINT AS turn, role, length(string_agg(text, ' ' ORDER BY turn)) AS n FROM r GROUP BY conv_id, run, role""")
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one speaker merged."""
    t = P.speaker_turns(T.table(spark, sf_dir, "conversations").withColumnRenamed("turn", "at"), "conv_id", "at", "role", "text")
    return t.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line, ' ') = '') AS n_blank, max(length(line)) AS longest FROM p GROUP BY doc_id""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, blank lines and the longest line per document."""
    lines = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.trim("line") == "", 1)).alias("n_blank"), F.max(F.length("line")).cast("long").alias("longest"))


@query("WITH RECURSIVE " + """mails AS (SELECT o_orderkey AS msgid, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 5 END AS reply, o_orderdate AS date FROM orders),
    t AS (SELECT msgid, msgid AS root, 0 AS depth FROM mails m WHERE reply IS NULL OR NOT EXISTS (SELECT 1 FROM mails p WHERE p.msgid = m.reply)
          UNION ALL SELECT m.msgid, t.root, t.depth + 1 FROM t JOIN mails m ON m.reply = t.msgid) SELECT msgid, root, depth FROM t""")
def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply trees with roots and depths (orders stand in for mails)."""
    o = T.table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("msgid"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 5).alias("in_reply_to"), F.col("o_orderdate").alias("date"))
    return P.mail_threads(m).select("msgid", "root", "depth")


@query("SELECT doc_id, lower(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) AS title, length(text) // 4 AS tokens, substr(sha256(text), 1, 16) AS hash FROM documents")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title text, token estimate and content hash of documents."""
    d = T.table(spark, sf_dir, "documents")
    title = F.lower(F.regexp_replace(F.substring("text", 1, 60), r"\s+", " "))
    return d.select("doc_id", title.alias("title"), X.token_estimate(F.col("text")).alias("tokens"), X.content_hash(F.col("text")).alias("hash"))
