"""Semantic-memory, resolution, sampling and selectivity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators import evaluation as E
from memlattice.operators import memory as M
from memlattice.operators import vectors as V
from memlattice.registry import query
from memlattice.sources import tables as T


@query("WITH " + T.EPISODES_SQL + ", g AS (SELECT session, list(id ORDER BY id) AS ids, count(*) AS n FROM episodes GROUP BY session), m AS (SELECT *, printf('M:%04d', row_number() OVER (ORDER BY session)) AS memory FROM g) SELECT memory AS s, 'abstracts' AS p, unnest(ids) AS o FROM m")
def abstract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory per session that abstracts its episodes."""
    e = T.episodes(spark, sf_dir).select(F.col("session").alias("group"), F.col("id").alias("source"), F.col("summary").alias("text"))
    return M.create_abstracts(e)[1]


@query("WITH " + T.EPISODES_SQL + " SELECT id, CASE WHEN id IN (SELECT follows FROM episodes WHERE follows IS NOT NULL) THEN 'superseded' ELSE 'current' END AS state FROM episodes")
def superseded_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes superseded by the one that follows them."""
    e = T.episodes(spark, sf_dir)
    pairs = e.where("follows IS NOT NULL").select(F.col("id").alias("new"), F.col("follows").alias("old"))
    state = e.select("id", F.lit("current").alias("state"), F.lit(None).cast("timestamp").alias("validity_end"))
    return M.supersede(state, pairs, F.lit("2026-08-01").cast("timestamp"))[0].select("id", "state")


@query("WITH " + T.EDGES_SQL + ", d AS (SELECT o FROM edges WHERE p = 'has_topic' GROUP BY o HAVING count(*) = 1) SELECT s, p, o, 'rare' AS reason FROM edges WHERE p = 'has_topic' AND o IN (SELECT o FROM d)")
def archived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic edges that move to the archive since their topic occurs once."""
    edges = T.edges(spark, sf_dir).where("p = 'has_topic'")
    once = edges.groupBy("o").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("o")
    return M.archive(edges, edges.join(once, "o", "left_semi"), "rare")[1]


@query("WITH " + T.EDGES_SQL + """, names AS (SELECT DISTINCT CASE WHEN length(o) % 2 = 0 THEN o ELSE substr(o, 3) END AS name FROM edges WHERE p = 'has_entity' UNION SELECT 'nobody'), nodes AS (SELECT DISTINCT o AS node FROM edges WHERE p = 'has_entity')
    SELECT name, coalesce((SELECT node FROM nodes WHERE node = name), (SELECT min(node) FROM nodes WHERE substr(node, 3) = name)) AS node FROM names""")
def resolved_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved to nodes by id, then by bare name."""
    nodes = T.edges(spark, sf_dir).where("p = 'has_entity'").select(F.col("o").alias("node")).distinct()
    names = nodes.select(F.when(F.length("node") % 2 == 0, F.col("node")).otherwise(F.substring("node", 3, 1000)).alias("name")).distinct()
    return M.resolve_endpoints(names.union(spark.createDataFrame([("nobody",)], "name string")), nodes)


@query("WITH " + T.EDGES_SQL + ", sc AS (SELECT node, count(*)::DOUBLE AS score FROM (SELECT unnest([s, o]) AS node FROM edges WHERE p = 'has_topic') GROUP BY node HAVING count(*) >= 2) SELECT s, p, o, (a.score + b.score) / 2 AS score FROM edges JOIN sc a ON a.node = s JOIN sc b ON b.node = o WHERE p = 'has_topic'")
def endpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic edges scored by both ends' degrees of two and more."""
    edges = T.edges(spark, sf_dir).where("p = 'has_topic'")
    sc = edges.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("score")).where("score >= 2")
    return M.edge_scores(edges, sc)


@query("WITH " + T.SECTIONS_SQL + """, t AS (SELECT doc, idx, greatest(1, length(body) // 4) AS tokens FROM sections),
    h AS (SELECT *, CASE WHEN tokens >= 64 OR row_number() OVER (PARTITION BY doc ORDER BY idx) = 1 THEN idx END AS head FROM t),
    o AS (SELECT *, max(head) OVER (PARTITION BY doc ORDER BY idx) AS owner FROM h) SELECT doc, owner AS idx, sum(tokens)::BIGINT AS tokens, count(*) AS merged FROM o GROUP BY ALL""")
def tiny_sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections below 64 tokens merged into the one before."""
    s = T.sections(spark, sf_dir).select("doc", "idx", X.token_estimate(F.col("body"), 1).alias("tokens"))
    return M.merge_tiny(s, "doc")


@query("WITH g AS (SELECT user_id AS source, count(*) AS n, max(value) AS probe, sum(value) AS s FROM events GROUP BY 1 HAVING count(*) >= 3) SELECT source, n, probe, round(probe - (s - probe) / (n - 1), 5) AS gap FROM g")
def selectivity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value of a source less the mean of its others."""
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("value").alias("score"))
    return M.selectivity(e).withColumn("gap", F.round("gap", 5))


@query("SELECT round(quantile_cont(value, 0.3), 6) AS recoverability, round(quantile_cont(value, 0.7), 6) AS relevance, round(quantile_cont(value, 0.8), 6) AS surprise FROM events")
def salience_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds at the 30th, 70th and 80th percentile."""
    e = T.table(spark, sf_dir, "events").select(F.lit(0).alias("all"), "value")
    q = E.quantiles(e, "all", "value", {"recoverability": 0.3, "relevance": 0.7, "surprise": 0.8})
    return q.select(*[F.round(c, 6).alias(c) for c in ("recoverability", "relevance", "surprise")])


@query("WITH " + T.EPISODES_SQL + ', s AS (SELECT "user", session, min(ts) AS t FROM episodes GROUP BY ALL) SELECT "user", session, lag(session) OVER (PARTITION BY "user" ORDER BY t, session) AS follows_session FROM s')
def previous_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions with the one before."""
    s = T.episodes(spark, sf_dir).groupBy("user", "session").agg(F.min("ts").alias("t"))
    return s.select("user", "session", F.lag("session").over(Window.partitionBy("user").orderBy("t", "session")).alias("follows_session"))


@query("WITH " + T.EDGES_SQL + """, c AS (SELECT e.o AS entity, count(DISTINCT e.s) AS n_episodes, count(DISTINCT t.o) AS n_topics, min(e.s) AS first_episode FROM edges e LEFT JOIN edges t ON t.s = e.s AND t.p = 'has_topic' WHERE e.p = 'has_entity' GROUP BY e.o) SELECT * FROM c WHERE n_episodes >= 2""")
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and topics around entities of two episodes or more."""
    edges = T.edges(spark, sf_dir)
    e = edges.where("p = 'has_entity'").select("s", F.col("o").alias("entity"))
    t = edges.where("p = 'has_topic'").select("s", F.col("o").alias("topic"))
    g = e.join(t, "s", "left").groupBy("entity").agg(F.countDistinct("s").alias("n_episodes"), F.countDistinct("topic").alias("n_topics"), F.min("s").alias("first_episode"))
    return g.where("n_episodes >= 2")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10")
def promoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with ten examples or more."""
    return T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("WITH " + T.EPISODES_SQL + " SELECT session, array_to_string(list_sort(list_distinct(flatten(list(topics)))), ',') AS topics, len(list_distinct(flatten(list(tones)))) AS n_tones FROM episodes GROUP BY session")
def session_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct topics and tones per session."""
    g = T.episodes(spark, sf_dir).groupBy("session")
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return g.agg(F.array_join(both("topics"), ",").alias("topics"), F.size(both("tones")).cast("long").alias("n_tones"))


@query("WITH " + T.EDGES_SQL + ", firsts AS (SELECT s, o, min(CASE p WHEN 'follows' THEN '1follows' WHEN 'has_entity' THEN '2has_entity' WHEN 'has_topic' THEN '3has_topic' ELSE '9' || p END) AS first FROM edges GROUP BY s, o) SELECT substr(first, 2) AS predicate, count(*) AS n FROM firsts GROUP BY 1")
def recovered_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first predicate, in vocabulary order, between each pair of nodes."""
    order = F.when(F.col("p") == "follows", "1").when(F.col("p") == "has_entity", "2").when(F.col("p") == "has_topic", "3").otherwise("9")
    first = T.edges(spark, sf_dir).groupBy("s", "o").agg(F.min(F.concat(order, "p")).alias("first"))
    return first.groupBy(F.substring("first", 2, 100).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS gold, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM p) SELECT query_id, vec_id FROM r WHERE k <= 20 AND NOT gold""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors of another label among the twenty nearest; queries are the ids divisible by 100."""
    v = T.table(spark, sf_dir, "embeddings")
    near = V.knn(v, v.where("vec_id % 100 = 0"), 20, 64).select("query_id", "vec_id")
    label = lambda c: v.select(F.col("vec_id").alias(c), F.col("label").alias(f"_{c}"))
    return near.join(label("query_id"), "query_id").join(label("vec_id"), "vec_id").where("_query_id <> _vec_id").select("query_id", "vec_id")


@query("WITH " + T.EDGES_SQL + """, e AS (SELECT DISTINCT s, o FROM edges WHERE p = 'has_entity'), ring AS (SELECT node, row_number() OVER (ORDER BY sha256('7|' || node), node) - 1 AS r, count(*) OVER () AS total FROM (SELECT DISTINCT o AS node FROM e)),
    positive AS (SELECT DISTINCT x.o AS a, y.o AS b FROM e x JOIN e y USING (s) WHERE x.o <> y.o), d AS (SELECT a AS node, count(*) AS d FROM positive GROUP BY a),
    steps AS (SELECT node AS a, r, total, unnest(range(1, 1 + least(total - 1, 2 + coalesce(d, 0)))) AS step FROM ring LEFT JOIN d USING (node)),
    free AS (SELECT a, ring.node AS b, step FROM steps JOIN ring ON ring.r = (steps.r + step) % steps.total WHERE NOT EXISTS (FROM positive WHERE positive.a = steps.a AND positive.b = ring.node))
    SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY step) AS n FROM free) WHERE n <= 2""")
def sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded pairs of entities that share no episode with each other's name."""
    edges = T.edges(spark, sf_dir).where("p = 'has_entity'")
    nodes = edges.select(F.col("o").alias("node")).distinct()
    e = edges.select("s", "o")
    shared = e.alias("x").join(e.alias("y"), "s").where("x.o <> y.o").select(F.col("x.o").alias("a"), F.col("y.o").alias("b")).distinct()
    return M.negative_pairs(shared, nodes, 2, 7)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN -1.0::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS reward, CASE WHEN value >= 100 THEN 'recall' WHEN value < 5 THEN 'stale_uncertain' ELSE 'dropped' END AS freshness FROM events")
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward of outcome signals and freshness class."""
    reward = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "signup", 0.5).otherwise(0.0)
    fresh = F.when(F.col("value") >= 100, "recall").when(F.col("value") < 5, "stale_uncertain").otherwise("dropped")
    return T.table(spark, sf_dir, "events").select("event_id", reward.alias("reward"), fresh.alias("freshness"))
