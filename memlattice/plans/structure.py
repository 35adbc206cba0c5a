"""Queries over outlines, chains and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators import chains as C
from memlattice.operators import classes as K
from memlattice.operators import graph as G
from memlattice.operators import outline as O
from memlattice.operators import planner as P
from memlattice.registry import query
from memlattice.sources import tables as T

#: Outlines of the documents: a line is a section, and the fewer words it has the deeper it lies.
_DEPTHS = ((40, 1), (15, 2), (6, 3))
_OUTLINE_SQL = T.SECTIONS_SQL + """, leveled AS (
        SELECT doc, idx, body AS content, CASE WHEN n >= 40 THEN 1 WHEN n >= 15 THEN 2 WHEN n >= 6 THEN 3 ELSE 4 END AS level FROM (SELECT *, len(string_split(body, ' ')) AS n FROM sections)
    ), wired AS (
        SELECT *, CASE level WHEN 2 THEN max(CASE WHEN level < 2 THEN idx END) OVER w WHEN 3 THEN max(CASE WHEN level < 3 THEN idx END) OVER w WHEN 4 THEN max(CASE WHEN level < 4 THEN idx END) OVER w END AS parent
        FROM leveled WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t4 AS (
        SELECT doc, idx, level, parent, content, 0 AS merged FROM wired
    )"""


def _absorb(level: int, source: str, target: str) -> str:
    tiny = f"level = {level} AND parent IS NOT NULL AND greatest(length(content) // 4, 1) < 64"
    return f""", {target} AS (
        SELECT doc, idx, level, parent, content || coalesce(chr(10) || chr(10) || more, '') AS content, merged + coalesce(n, 0) AS merged
        FROM (FROM {source} WHERE NOT coalesce({tiny}, false)) LEFT JOIN (
            SELECT doc, parent AS idx, string_agg(content, chr(10) || chr(10) ORDER BY idx) AS more, sum(merged + 1) AS n FROM {source} WHERE {tiny} GROUP BY ALL
        ) USING (doc, idx))"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections of an outline (doc, idx, level, content)."""
    n, level = F.size(F.split("body", " ")), F.lit(4)
    for words, depth in reversed(_DEPTHS):
        level = F.when(n >= words, depth).otherwise(level)
    return T.sections(spark, sf_dir).select("doc", "idx", level.alias("level"), F.col("body").alias("content"))


@query("WITH " + _OUTLINE_SQL + _absorb(4, "t4", "t3") + _absorb(3, "t3", "t2") + _absorb(2, "t2", "t1") + """
    SELECT doc, idx, level, coalesce(CASE level WHEN 2 THEN max(CASE WHEN level < 2 THEN idx END) OVER w WHEN 3 THEN max(CASE WHEN level < 3 THEN idx END) OVER w WHEN 4 THEN max(CASE WHEN level < 4 THEN idx END) OVER w END, -1) AS parent,
           greatest(length(content) // 4, 1) AS tokens, merged::BIGINT AS merged, sha256(content) AS digest
    FROM t1 WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def contracted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of documents with sections below 64 tokens moved into their parents, deepest first; -1 is no parent."""
    return O.contracted(outline(spark, sf_dir), "doc").select("doc", "idx", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), "tokens", "merged", F.sha2("content", 256).alias("digest"))


#: The episode after another one is the next of its chain.
_WALK_SQL = "WITH RECURSIVE " + T.EPISODES_SQL + """, walk AS (
        SELECT id AS node, id AS chain, 0 AS position FROM episodes WHERE follows IS NULL AND id IN (SELECT follows FROM episodes)
        UNION ALL SELECT episodes.id, chain, position + 1 FROM walk JOIN episodes ON follows = node
    )"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(spark, sf_dir).where("p = 'follows'").select(F.col("o").alias("node"), F.col("s").alias("next"))


@query(_WALK_SQL + " SELECT node, chain, position::BIGINT AS position, count(*) OVER (PARTITION BY chain) AS length, false AS cyclic FROM walk")
def episode_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain, position and length of every episode with a neighbour."""
    return C.ranked_chains(_links(spark, sf_dir))


@query(_WALK_SQL + " SELECT chain AS start, position::BIGINT AS position, node, count(*) OVER (PARTITION BY chain) AS length FROM walk WHERE position < 64")
def episode_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks along the episodes, 64 at most, from every first one."""
    return C.walked_chains(_links(spark, sf_dir))


@query(_WALK_SQL + " SELECT chain, string_agg(tones, ';' ORDER BY position) AS states FROM (SELECT chain, position, array_to_string(e.tones, '+') AS tones FROM walk JOIN episodes e ON e.id = node WHERE position < 64) GROUP BY chain")
def tone_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones along each chain, put together from its pairs of neighbours."""
    e = T.episodes(spark, sf_dir).select(F.col("id").alias("node"), F.array_join("tones", "+").alias("state"))
    placed = C.walked_chains(_links(spark, sf_dir)).join(e, "node").select(F.col("start").alias("chain"), "position", "state")
    after = placed.select("chain", (F.col("position") - 1).alias("position"), F.col("state").alias("next_state"))
    pairs = placed.join(after, ["chain", "position"]).withColumn("type", F.lit("forward"))
    return C.chain_sequences(pairs).select("chain", F.array_join("sequence", ";").alias("states"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    parts AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY ALL), c AS (SELECT label AS class, list(m ORDER BY i) AS m FROM parts GROUP BY label),
    p AS (SELECT vec_id AS entity, class, round(list_dot_product(e, m), 6) AS score FROM v, c)
    SELECT entity, class, score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, class) AS r FROM p) WHERE r <= 3""")
def class_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three classes nearest to each vector by dot product; a class is the mean vector of a label."""
    v = T.table(spark, sf_dir, "embeddings")
    entities = v.select(F.col("vec_id").alias("entity"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    means = v.select("label", F.posexplode("embedding").alias("_i", "_x")).groupBy("label", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_r")).select(F.col("label").cast("long").alias("class"), F.transform("_r", lambda x: x["_m"]).alias("vector"))
    return K.nearest_classes(entities, vectors, 3).select("entity", "class", "score")


@query("""WITH c AS (SELECT DISTINCT lang || ':' || source AS class FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), r AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS n, count(*) OVER () AS total FROM c)
    SELECT run, class FROM r, (SELECT unnest(range(0, 3))::INTEGER AS run) WHERE (n - run * 7) % total < 7 AND n >= run * 7 OR (n + total - run * 7) % total < 7 AND n < run * 7""")
def rotated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of seven classes that three runs in a row consider."""
    classes = T.table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.concat_ws(":", "lang", "source").alias("class")).distinct()
    return K.rotated(classes, 7, K.new_folder(spark), runs=3)


#: The dictionary: words and pairs of words of the benchmark's passages are topics, words of six letters or more tones; what
#: begins a passage is no entity.
_PLANNER_SQL = """
    WITH bw AS (
        SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM benchmark
    ), placed AS (
        SELECT item_id, i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM bw)
    ), dict AS (
        SELECT DISTINCT a AS p, 1 AS size, 'topic' AS kind, a AS label FROM placed WHERE i <= 4 UNION SELECT DISTINCT a || ' ' || b, 2, 'topic', a || '_' || b FROM placed WHERE i <= 4 AND b IS NOT NULL
        UNION SELECT DISTINCT a, 1, 'tone', substr(a, 1, 3) FROM placed WHERE i > 4 AND length(a) >= 6 UNION SELECT 'the', 1, 'joint', 'the'
    ), stop AS (
        SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS k FROM benchmark
    ), prompts AS (
        SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE role = 'user'
    ), pw AS (
        SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM prompts
    ), spans AS (
        SELECT id, i - 1 AS start, 1 AS size, ws[i] AS p FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM pw) UNION ALL SELECT id, i - 1, 2, ws[i] || ' ' || ws[i + 1] FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM pw)
    ), met AS (
        SELECT id, kind, start, size, min(label) AS label, start + size AS fin FROM spans JOIN dict USING (p, size) GROUP BY id, kind, start, size
    ), kept AS (
        SELECT * FROM met QUALIFY coalesce(max(fin) OVER (PARTITION BY id, kind ORDER BY start, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < fin, true)
    ), labels AS (
        SELECT id, kind, string_agg(label, ',' ORDER BY s, label) AS ls FROM (SELECT id, kind, label, min(start) AS s FROM kept GROUP BY ALL) GROUP BY id, kind
    ), ents AS (
        SELECT id, string_agg(e, ',' ORDER BY i) AS es, count(*) AS n FROM (
            SELECT id, e, min(i) AS i FROM (SELECT id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+')) AS e, generate_subscripts(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+'), 1) AS i FROM prompts) WHERE regexp_full_match(e, '[A-Z][a-z]+') GROUP BY id, e
        ) WHERE lower(e) NOT IN (SELECT k FROM stop) GROUP BY id
    )"""


@query(_PLANNER_SQL + """ SELECT prompts.id, coalesce(es, '') AS entities, coalesce(t.ls, '') AS topics, coalesce(o.ls, '') AS tones,
        CASE WHEN j.ls IS NOT NULL AND coalesce(n, 0) > 1 THEN 'intersection' ELSE 'union' END AS entity_mode
    FROM prompts LEFT JOIN ents USING (id) LEFT JOIN labels t ON t.id = prompts.id AND t.kind = 'topic' LEFT JOIN labels o ON o.id = prompts.id AND o.kind = 'tone' LEFT JOIN labels j ON j.id = prompts.id AND j.kind = 'joint'""")
def keyword_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all user turns from a dictionary of phrases, the longest phrase first."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    bench = T.table(spark, sf_dir, "benchmark")
    placed = bench.select(words.alias("_w")).select(F.posexplode("_w").alias("i", "a"), "_w").withColumn("b", F.get("_w", F.col("i") + 1))
    entry = lambda df, phrase, kind, label: df.select(phrase.alias("phrase"), F.lit(kind).alias("kind"), label.alias("label"))
    early, late = placed.where("i < 4"), placed.where("i >= 4 AND length(a) >= 6")
    entries = entry(early, F.col("a"), "topic", F.col("a")).unionByName(entry(early.where("b IS NOT NULL"), F.concat_ws(" ", "a", "b"), "topic", F.concat_ws("_", "a", "b")))
    entries = entries.unionByName(entry(late, F.col("a"), "tone", F.substring("a", 1, 3))).unionByName(entry(spark.range(1), F.lit("the"), "joint", F.lit("the")))
    stop = bench.select(F.regexp_extract("text", "([A-Za-z]+)", 1).alias("word"))
    prompts = T.table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    found = P.planned(prompts, entries, stop, 2026)
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("entities", "topics", "tones")], "entity_mode")


@query("WITH " + T.EDGES_SQL + " SELECT DISTINCT s AS node, o AS next FROM edges WHERE p = 'has_topic' AND s IN (SELECT id FROM episodes WHERE follows IS NULL)")
def topic_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the first episode of every session, one hop ahead."""
    seeds = T.episodes(spark, sf_dir).where("follows IS NULL").select(F.col("id").alias("node"))
    return G.out_hop(seeds, T.edges(spark, sf_dir), "has_topic").distinct()


@query("WITH " + T.EDGES_SQL + " SELECT DISTINCT o AS node, s AS next FROM edges WHERE p = 'in_session' AND o IN (SELECT session FROM episodes WHERE len(tones) > 1)")
def session_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the sessions that have one of several tones, one hop back."""
    seeds = T.episodes(spark, sf_dir).where("size(tones) > 1").select(F.col("session").alias("node")).distinct()
    return G.in_hop(seeds, T.edges(spark, sf_dir), "in_session").distinct()
