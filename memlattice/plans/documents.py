"""Document, ontology and planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import language as N
from memlattice.functions import text as X
from memlattice.operators import citations as I
from memlattice.operators import documents as D
from memlattice.operators import graph as G
from memlattice.registry import query
from memlattice.sources import tables as T

_S = "WITH " + T.SECTIONS_SQL


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sections(spark, sf_dir)
    return s.select(F.col("source").alias("query_id"), "doc", "section", (F.length("body") % 97).cast("double").alias("score"), X.capitalised(F.col("body"), 7).alias("entities"))


@query(_S + """, h AS (SELECT source AS query_id, doc, section, (length(body) % 97)::DOUBLE AS score, list_distinct(regexp_extract_all(body, '[A-Z][a-z]{6,}')) AS entities FROM sections),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, section) AS r FROM h)
    SELECT query_id, doc, max(score) AS score, count(*) AS n_sections, array_to_string(list(section ORDER BY r) FILTER (r <= 5), ',') AS top_sections,
           coalesce(array_to_string(list_sort(list_distinct(flatten(list(entities)))), ','), '') AS entity_list FROM r GROUP BY ALL""")
def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section hits aggregated to documents."""
    r = D.document_results(_hits(spark, sf_dir))
    return r.select("query_id", "doc", "score", "n_sections", F.array_join("sections", ",").alias("top_sections"), F.array_join("entities", ",").alias("entity_list"))


@query("""WITH RECURSIVE c AS (SELECT p_type AS child, regexp_replace(p_type, ' [^ ]+$', '') AS parent FROM part WHERE contains(p_type, ' ') UNION SELECT regexp_replace(p_type, ' [^ ]+$', ''), regexp_replace(p_type, ' .*$', '') FROM part WHERE regexp_matches(p_type, ' .* ') UNION SELECT regexp_replace(p_type, ' .*$', ''), 'thing' FROM part),
    w AS (SELECT child, parent AS ancestor, 1 AS distance FROM c UNION SELECT w.child, c.parent, distance + 1 FROM w JOIN c ON c.child = w.ancestor) SELECT child, ancestor, min(distance)::INTEGER AS distance FROM w GROUP BY ALL""")
def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of every class of a type hierarchy."""
    p = T.table(spark, sf_dir, "part").select("p_type").distinct()
    up = F.regexp_replace("p_type", " [^ ]+$", "")
    top = F.regexp_replace("p_type", " .*$", "")
    classes = p.where(F.col("p_type").contains(" ")).select(F.col("p_type").alias("child"), up.alias("parent"))
    classes = classes.union(p.where(F.col("p_type").rlike(" .* ")).select(up, top)).union(p.select(top, F.lit("thing"))).distinct()
    return D.class_closure(classes)


@query("WITH RECURSIVE " + T.SECTIONS_SQL + """, p AS (SELECT doc, idx, greatest(1, length(body) // 4) AS t, row_number() OVER (PARTITION BY doc ORDER BY idx) AS r FROM sections),
    f AS (SELECT doc, r, idx, 0::BIGINT AS chunk, t AS used FROM p WHERE r = 1
          UNION ALL SELECT p.doc, p.r, p.idx, CASE WHEN f.used + p.t > 256 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + p.t > 256 THEN p.t ELSE f.used + p.t END FROM f JOIN p ON p.doc = f.doc AND p.r = f.r + 1)
    SELECT doc, idx, chunk FROM f""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections packed greedily into chunks of 256 tokens."""
    s = T.sections(spark, sf_dir).select("doc", "idx", X.token_estimate(F.col("body"), 1).alias("tokens"))
    return D.greedy_chunks(s, "doc", 256)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[/\\x00]') THEN 'h_' || substr(sha256(text), 1, 16) ELSE text END AS key FROM documents")
def safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as key components."""
    return T.table(spark, sf_dir, "documents").select("doc_id", X.safe_key(F.col("text")).alias("key"))


@query("WITH p AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN regexp_matches(low, '\\b(both|together|and also)\\b') THEN 'intersection' ELSE 'union' END AS entity_mode, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) > 3 AS many, length(text) // 4 AS tokens FROM p")
def planned_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based plans of user prompts."""
    p = T.table(spark, sf_dir, "conversations").where("role = 'user'")
    many = F.size(X.capitalised(F.col("text"))) > 3
    return p.select("conv_id", "turn", N.entity_mode(F.col("text")).alias("entity_mode"), many.alias("many"), X.token_estimate(F.col("text")).alias("tokens"))


#: A state in SQL: macros are not at hand, so key and value go through the same expressions for every way to cut a line.
def _state_sql(name: str, source: str, key: str, value: str) -> str:
    return f"""{name}_cut AS (
        SELECT doc, idx, line, list_filter(regexp_split_to_array(lower({key}), '\\s+'), lambda w: w <> '') AS named, trim(rtrim(trim({value}, ' '), '.,;'), ' ') AS said FROM {source}
    ), {name}_bare AS (
        SELECT *, CASE WHEN len(named) > 1 AND named[1] IN ('the', 'a', 'an', 'our', 'my') THEN named[2:] ELSE named END AS bare FROM {name}_cut
    ), {name} AS (
        SELECT doc, idx, line, array_to_string(bare, ' ') AS key, said AS value FROM {name}_bare
        WHERE len(named) > 0 AND len(list_filter(named, lambda w: NOT regexp_full_match(w, '[a-z0-9_-]+'))) = 0 AND regexp_matches(named[1], '^[a-z]')
          AND len(bare) BETWEEN 1 AND 6 AND length(array_to_string(named, ' ')) <= 61 AND length(said) BETWEEN 1 AND 120
    )"""


_FIELDS_SQL = _S + """, lined AS (
        SELECT doc, idx, body AS line, least(nullif(instr(body, ':'), 0), nullif(instr(body, '='), 0)) AS sep FROM sections
    ), """ + _state_sql("field", "(FROM lined WHERE sep IS NOT NULL)", "substr(line, 1, sep - 1)", "substr(line, sep + 1)")

_STATES_SQL = _FIELDS_SQL + """, worded AS (
        SELECT doc, idx, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM lined WHERE (doc, idx) NOT IN (SELECT (doc, idx) FROM field)
    ), placed AS (
        SELECT *, list_min(list_filter(range(2, len(ws) + 1), lambda i: lower(ws[i]) IN ('is', 'are', 'was'))) AS copula,
               list_min(list_filter(range(2, len(ws) + 1), lambda i: lower(ws[i]) = 'became' OR (lower(ws[i]) IN ('changed', 'moved', 'switched', 'updated') AND lower(coalesce(ws[i + 1], '')) = 'to'))) AS change FROM worded
    ), """ + _state_sql("copular", "(FROM placed WHERE copula IS NOT NULL)", "array_to_string(ws[1:copula - 1], ' ')", "array_to_string(ws[copula + CASE WHEN lower(coalesce(ws[copula + 1], '')) = 'now' THEN 2 ELSE 1 END:], ' ')") + ", " + _state_sql(
    "changed", "(FROM placed WHERE change IS NOT NULL AND (doc, idx) NOT IN (SELECT (doc, idx) FROM copular))", "array_to_string(ws[1:change - 1], ' ')", "array_to_string(ws[change + CASE WHEN lower(ws[change]) = 'became' THEN 1 ELSE 2 END:], ' ')"
)


@query(_FIELDS_SQL + " SELECT doc, (SELECT count(*) FROM field WHERE field.doc = d.doc) AS n_pairs FROM (SELECT DISTINCT doc FROM sections) d")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the form key: value or key = value per document."""
    s = T.sections(spark, sf_dir).select("doc", N.field(F.col("body")).alias("k"))
    return s.groupBy("doc").agg(F.count("k").alias("n_pairs"))


@query(_STATES_SQL + """ SELECT doc, idx, key, value FROM (
        SELECT *, row_number() OVER (PARTITION BY doc, key, lower(value) ORDER BY idx) AS n FROM (FROM field UNION ALL FROM copular UNION ALL FROM changed)) WHERE n = 1""")
def asserted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State assertions found in document lines, each key and value once per document."""
    s = T.sections(spark, sf_dir).select("doc", "idx", N.assertion(F.col("body")).alias("a")).where("a IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("doc", "a.key", F.lower("a.value")).orderBy("idx"))
    return s.withColumn("_n", first).where("_n = 1").select("doc", "idx", "a.key", "a.value")


@query("""WITH n AS (SELECT lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t, doc_id FROM documents), b AS (SELECT item_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS raw FROM benchmark),
    c AS (SELECT item_id, regexp_replace(raw, '^[ .,;:!?"''()\\[\\]-]+|[ .,;:!?"''()\\[\\]-]+$', '', 'g') AS title FROM b)
    SELECT doc_id AS id, item_id AS doc FROM n JOIN c ON contains(n.t, c.title) WHERE length(c.title) >= 4""")
def cited_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that occur in documents."""
    texts = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    titles = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.col("text").alias("title"))
    return I.cited_documents(texts, titles)


@query(_S + """, named AS (SELECT DISTINCT unnest(regexp_extract_all(body, '[A-Z][a-z]{5,}')) AS title FROM sections), turns AS (SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id || '/' || turn AS id, title AS doc FROM turns JOIN named ON contains(t, lower(title))""")
def named_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents' lines that occur in turns, also inside words: many short titles."""
    titles = T.sections(spark, sf_dir).select(F.explode(X.capitalised(F.col("body"), 6)).alias("title")).distinct().select(F.col("title").alias("doc"), "title")
    texts = T.table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return I.cited_documents(texts, titles)


@query("WITH " + T.EDGES_SQL + """, sub AS (SELECT DISTINCT e.o AS center, n.s AS node FROM edges e JOIN edges n ON n.o = e.o AND n.p = 'in_session' WHERE e.p = 'in_session'),
    cand AS (SELECT a.center, a.node AS a, b.node AS b FROM sub a JOIN sub b ON a.center = b.center AND a.node < b.node),
    free AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM edges WHERE p = 'follows' AND ((s = a AND o = b) OR (s = b AND o = a))))
    SELECT center, a, b FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY a, b) AS r FROM free) WHERE r <= 6""")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of one session without a follows edge, six pairs at most."""
    edges = T.edges(spark, sf_dir)
    nodes = edges.where("p = 'in_session'").select(F.col("o").alias("center"), F.col("s").alias("node"), F.lit("episode").alias("kind"))
    return D.nonadjacent_pairs(nodes, edges.where("p = 'follows'"), 6)


@query("WITH " + T.EDGES_SQL + ", k AS (SELECT id FROM episodes WHERE length(reply) >= 800) SELECT s, p, o FROM edges WHERE p = 'follows' AND s IN (SELECT id FROM k) AND o IN (SELECT id FROM k)")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows edges between long episodes."""
    e = T.episodes(spark, sf_dir)
    kept = e.where(F.length("reply") >= 800).select(F.col("id").alias("node"))
    return G.induced(T.edges(spark, sf_dir).where("p = 'follows'"), kept)


@query("WITH " + T.EDGES_SQL + """, m AS (SELECT s, p, o, CASE WHEN length(o) % 3 = 0 THEN 'archived' ELSE 'current' END AS state FROM edges WHERE p = 'has_entity' AND length(o) % 2 = 0)
    SELECT edges.s, edges.p, edges.o FROM edges LEFT JOIN m USING (s, p, o) WHERE edges.p = 'has_entity' AND coalesce(state, 'current') = 'current'""")
def edges_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity edges that no sidecar has archived."""
    edges = T.edges(spark, sf_dir).where("p = 'has_entity'")
    meta = edges.where("length(o) % 2 = 0").select("s", "p", "o", F.when(F.length("o") % 3 == 0, "archived").otherwise("current").alias("state"))
    return G.current_edges(edges, meta).select("s", "p", "o")


@query("WITH " + T.EDGES_SQL + ", n AS (SELECT o AS node, s AS center FROM edges WHERE p = 'has_topic') SELECT center, node, ((row_number() OVER (PARTITION BY center ORDER BY node) - 1) // 4)::BIGINT AS shard FROM n")
def node_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraph nodes in shards of four."""
    n = T.edges(spark, sf_dir).where("p = 'has_topic'").select(F.col("s").alias("center"), F.col("o").alias("node"))
    return D.shards(n, "center", 4)


@query("WITH " + T.EPISODES_SQL + ", u AS (SELECT id, 'episode' AS kind FROM episodes UNION SELECT printf('doc_%06d', doc_id), 'document' FROM documents UNION SELECT 'U:' || user_id, 'user' FROM events) SELECT kind, count(*) AS n FROM u GROUP BY kind")
def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of all unit ids by kind."""
    e = T.episodes(spark, sf_dir).select("id", F.lit("episode").alias("kind"))
    d = T.table(spark, sf_dir, "documents").select(F.format_string("doc_%06d", "doc_id"), F.lit("document"))
    u = T.table(spark, sf_dir, "events").select(F.concat(F.lit("U:"), F.col("user_id").cast("string")), F.lit("user"))
    return e.union(d).union(u).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return T.table(spark, sf_dir, "documents").select("doc_id").join(T.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, round(count(quality) / count(*)::DOUBLE, 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled share per language."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled")).withColumn("coverage", F.round(F.col("labelled") / F.col("n"), 6))


@query("SELECT 'U:' || user_id AS unit, event_id, 'ep_' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::VARCHAR, 6, '0') AS id FROM events")
def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonic ids in time order within each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.table(spark, sf_dir, "events").select(
        F.concat(F.lit("U:"), F.col("user_id").cast("string")).alias("unit"), "event_id", F.format_string("ep_%06d", F.row_number().over(w)).alias("id")
    )
