"""Queries of upkeep: the consolidation pass and the context of flagged nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators import dream as D
from memlattice.operators import flagged as G
from memlattice.operators import injection as J
from memlattice.registry import query
from memlattice.sources import tables as T
from memlattice.sources.sinks import shared_folder

#: The pass's time and rules on these tables.
NOW = "2026-09-15 00:00:00"
RULES = D.Rules(("has_entity", "has_topic"), half_life=17.0, faded=0.05, dull=0.15, sure=0.1)

_MEMORY_SQL = T.EDGES_SQL + ", " + T.ASSERTIONS_SQL + """, tied AS (
        SELECT DISTINCT s, p, o FROM edges WHERE p IN ('has_entity', 'has_topic')
    ), every AS (
        SELECT s, p, o, ts AS seen FROM tied JOIN episodes ON id = s
        UNION ALL SELECT DISTINCT s, p, o, NULL FROM edges WHERE p = 'follows'
        UNION ALL SELECT entity, 'state', value, max(asserted_at) FROM assertions GROUP BY entity, value
    ), degree AS (
        SELECT node, least(1, 0.1 + 0.03 * sqrt(count(*))) AS score FROM (SELECT s AS node FROM tied UNION ALL SELECT o FROM tied) GROUP BY node
    ), last_state AS (
        SELECT s, arg_max(o, (seen, o)) AS o, count(*) AS n FROM every WHERE p = 'state' GROUP BY s
    ), weaker AS (
        SELECT s, p, o, pow(0.5::DOUBLE, (epoch(TIMESTAMP '2026-09-15 00:00:00') - epoch(seen)) / 86400.0::DOUBLE / 17.0::DOUBLE) AS w FROM every WHERE p IN ('has_entity', 'has_topic') AND seen < TIMESTAMP '2026-09-15 00:00:00'
    ), two_back AS (
        SELECT id AS s, lag(id, 2) OVER c AS o, topics AS a, lag(topics, 2) OVER c AS b FROM episodes WINDOW c AS (PARTITION BY conv_id ORDER BY turn)
    ), likely AS (
        SELECT s, o FROM two_back WHERE o IS NOT NULL AND len(list_intersect(a, b)) >= 0.1 * (len(a) + len(b) - len(list_intersect(a, b))) AND len(a) + len(b) > 0
    ), found AS (
        SELECT every.s, p, every.o, 0 AS rank, 1.0::DOUBLE AS strength FROM every JOIN last_state l ON l.s = every.s AND p = 'state' AND l.o <> every.o
        UNION ALL SELECT s, p, o, 2, 1.0 FROM tied JOIN degree x ON x.node = s JOIN degree y ON y.node = o WHERE x.score < 0.15 AND y.score < 0.15
        UNION ALL SELECT s, p, o, CASE WHEN w < 0.05 THEN 3 ELSE 4 END, w FROM weaker
        UNION ALL SELECT s, 'related', o, 5, 1.0 FROM likely
    ), decided AS (
        SELECT s, p, o, ['supersede', 'remove', 'prune', 'archive', 'decay', 'propose'][min(rank) + 1] AS action, arg_min(strength, rank) AS strength FROM found GROUP BY s, p, o
    )"""


def memory(spark: SparkSession, sf_dir: str) -> tuple[D.Memory, DataFrame]:
    """The tables that a pass works on, and scored candidates for new edges: episodes two apart, by the likeness of their topics."""
    edges, eps, said = T.edges(spark, sf_dir), T.episodes(spark, sf_dir), T.assertions(spark, sf_dir)
    tied = edges.where(F.col("p").isin(*RULES.associations)).distinct()
    states = said.groupBy(F.col("entity").alias("s"), F.lit("state").alias("p"), F.col("value").alias("o")).agg(F.max("asserted_at").alias("seen"))
    seen = tied.join(eps.select(F.col("id").alias("s"), F.col("ts").alias("seen")), "s").select("s", "p", "o", "seen").unionByName(states)
    sidecar = seen.select("s", "p", "o", F.lit("current").alias("state"), F.lit(1.0).alias("strength"), "seen", F.lit(None).cast("timestamp").alias("until"))
    ends = tied.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    salience = ends.select("node", F.least(F.lit(1.0), F.lit(0.1) + F.lit(0.03) * F.sqrt("_n")).alias("score"))
    whole = tied.unionByName(edges.where("p = 'follows'").distinct()).unionByName(states.select("s", "p", "o"))
    numbered = eps.select("conv_id", F.col("turn"), "id", "topics")
    chain = Window.partitionBy("conv_id").orderBy("turn")
    pairs = numbered.select(F.col("id").alias("s"), F.lit("related").alias("p"), F.lag("id", 2).over(chain).alias("o"), X.jaccard(F.col("topics"), F.lag("topics", 2).over(chain)).alias("score"))
    archive = spark.createDataFrame([], "s string, p string, o string, reason string")
    return D.Memory(whole, sidecar, salience, archive), pairs.where("o IS NOT NULL")


@query("WITH " + _MEMORY_SQL + " SELECT s, p, o, action, round(strength, 6) AS strength FROM decided")
def dream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the pass: one decision per edge."""
    decided, _ = D.consolidate(*memory(spark, sf_dir), RULES, F.lit(NOW).cast("timestamp"))
    return decided.select("s", "p", "o", "action", F.round("strength", 6).alias("strength"))


@query("WITH " + _MEMORY_SQL + """, after AS (
        SELECT s, p, o, CASE action WHEN 'supersede' THEN 'superseded' WHEN 'archive' THEN 'archived' ELSE 'current' END AS state, round(coalesce(strength, 1.0), 6) AS strength, 'edge' AS kept
        FROM (SELECT s, p, o FROM every UNION SELECT s, p, o FROM decided) LEFT JOIN decided USING (s, p, o) WHERE coalesce(action, '') <> 'prune'
    ) FROM after UNION ALL SELECT s, p, o, 'archived', 1.0, 'archive' FROM decided WHERE action = 'prune'""")
def dream_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the version that the pass writes, with state and strength, and what went to the archive."""
    folder = f"{shared_folder(spark).rstrip('/')}/dream-{uuid.uuid4().hex[:12]}"
    _, after = D.consolidate(*memory(spark, sf_dir), RULES, F.lit(NOW).cast("timestamp"), folder)
    side = after.sidecar.select("s", "p", "o", "state", "strength")
    edges = after.edges.join(side, ["s", "p", "o"], "left").select("s", "p", "o", F.coalesce("state", F.lit("current")).alias("state"), F.round(F.coalesce("strength", F.lit(1.0)), 6).alias("strength"), F.lit("edge").alias("kept"))
    return edges.unionByName(after.archive.select("s", "p", "o", F.lit("archived").alias("state"), F.lit(1.0).alias("strength"), F.lit("archive").alias("kept")))


#: Subgraphs of users: their episodes and what these name; an episode's content is its tones, its states are its sizes.
_USERS_SQL = T.EDGES_SQL + """, inside AS (
        SELECT "user" AS center, id AS node FROM episodes UNION SELECT "user", 'E:' || unnest(entities) FROM episodes
    ), walked AS (
        SELECT DISTINCT i.center, s, p, o FROM edges JOIN inside i ON i.node = s JOIN inside j ON j.node = o AND j.center = i.center WHERE p IN ('has_entity', 'follows')
    ), states AS (
        SELECT id AS s, 'state' AS p, 'long' AS o FROM episodes WHERE length(reply) > 1500 UNION ALL SELECT id, 'state', 'short' FROM episodes WHERE length(prompt) < 200
    ), whole AS (
        SELECT center, s, p, o FROM walked UNION SELECT center, s, p, o FROM states JOIN inside ON node = s WHERE NOT (o = 'short' AND s IN (SELECT id FROM episodes WHERE follows IS NOT NULL))
    ), told AS (
        SELECT center, node, array_to_string(list_sort(tones), '+') AS content FROM inside LEFT JOIN episodes ON id = node
    ), asked AS (
        SELECT "user" AS center, id AS flag FROM episodes WHERE follows IS NULL
    ), near AS (
        SELECT center, flag, o AS node FROM asked JOIN walked USING (center) WHERE s = flag UNION SELECT center, flag, s FROM asked JOIN walked USING (center) WHERE o = flag
    ), twins AS (
        SELECT a.center, flag, y.node, row_number() OVER (PARTITION BY a.center, flag ORDER BY y.node) AS n
        FROM asked a JOIN told x ON x.center = a.center AND x.node = flag JOIN told y ON y.center = a.center AND y.content = x.content AND y.node <> flag WHERE x.content <> ''
    ), members AS (
        SELECT center, flag, node, min(r) AS r FROM (
            SELECT center, flag, flag AS node, 0 AS r FROM asked UNION ALL SELECT center, flag, node, 1 FROM near UNION ALL SELECT center, flag, node, 2 FROM twins WHERE n <= 8
        ) GROUP BY ALL
    )"""


def users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged, nodes with content, enriched edges) of the users' subgraphs; the first episode of a session is flagged."""
    eps, edges = T.episodes(spark, sf_dir), T.edges(spark, sf_dir).where("p IN ('has_entity', 'follows')")
    named = eps.select(F.col("user").alias("center"), F.explode("entities").alias("_e")).select("center", F.concat(F.lit("E:"), "_e").alias("node"))
    inside = eps.select(F.col("user").alias("center"), F.col("id").alias("node")).unionByName(named).distinct()
    other = inside.select("center", F.col("node").alias("o"))
    walked = inside.withColumnRenamed("node", "s").join(edges, "s").join(other, ["center", "o"], "left_semi").select("center", "s", "p", "o")
    sizes = F.array(F.when(F.length("reply") > 1500, "long"), F.when(F.length("prompt") < 200, "short"))
    states = eps.select(F.col("id").alias("s"), F.lit("state").alias("p"), F.explode(F.filter(sizes, lambda x: x.isNotNull())).alias("o"), "follows")
    gone = states.where("o = 'short' AND follows IS NOT NULL").select("s", "p", "o")
    tones = eps.select(F.col("id").alias("node"), F.array_join(F.array_sort("tones"), "+").alias("summary"))
    nodes, whole = G.enriched(inside, walked, states.select("s", "p", "o"), gone, tones)
    flagged = eps.where("follows IS NULL").select(F.col("user").alias("center"), F.col("id").alias("flag"))
    return flagged, nodes.withColumnRenamed("summary", "content"), whole


@query("WITH " + _USERS_SQL + " SELECT center, flag, node, ['self', 'neighbour', 'twin'][r + 1] AS role FROM members")
def flagged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in the context of each flagged episode: itself, neighbours, eight content twins."""
    return G.flagged_context(*users(spark, sf_dir))[0]


@query("WITH " + _USERS_SQL + """ SELECT DISTINCT m.center, m.flag, s, p, o FROM members m JOIN whole w ON w.center = m.center AND s = m.node
    WHERE p = 'state' OR EXISTS (FROM members x WHERE x.center = m.center AND x.flag = m.flag AND x.node = o)""")
def flagged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of those contexts, states among them unless superseded."""
    return G.flagged_context(*users(spark, sf_dir))[1]


#: Users' subgraphs with sessions and decisions; a decision is the first sentence of a reply.
_PLANTED_SQL = T.EDGES_SQL + """, nodes AS (
        SELECT "user" AS center, "user" AS node, NULL AS content FROM episodes UNION SELECT "user", session, NULL FROM episodes UNION SELECT "user", id, summary FROM episodes
        UNION SELECT "user", 'D:' || id, regexp_extract(reply, '^[^.]*') FROM episodes UNION SELECT "user", 'E:' || unnest(entities), NULL FROM episodes
    ), links AS (
        SELECT "user" AS center, "user" AS s, 'has_session' AS p, session AS o FROM episodes UNION SELECT "user", id, 'in_session', session FROM episodes UNION SELECT "user", id, 'has_entity', 'E:' || unnest(entities) FROM episodes
        UNION SELECT "user", id, 'has_decision', 'D:' || id FROM episodes UNION SELECT "user", id, 'follows', follows FROM episodes WHERE follows IS NOT NULL
    ), signed AS (
        SELECT center, node, CASE WHEN node LIKE 'ep%' THEN 'duplicate_episode' ELSE 'duplicate_decision' END AS kind,
               list_sort(list_distinct(regexp_extract_all(lower(CASE WHEN node LIKE 'D:%' THEN coalesce(content, substr(node, 3)) ELSE content END), '[0-9a-z]+'))) AS h FROM nodes WHERE node LIKE 'ep%' OR node LIKE 'D:%'
    ), found AS (
        SELECT center, node, kind FROM signed WHERE len(h) > 0 QUALIFY count(*) OVER (PARTITION BY center, kind, h) > 1
        UNION SELECT center, node, CASE WHEN node LIKE 'D:%' THEN 'orphan_decision' ELSE 'detached_episode' END FROM nodes n WHERE (node LIKE 'ep%' OR node LIKE 'D:%') AND NOT EXISTS (FROM links l WHERE l.center = n.center AND (s = node OR o = node))
        UNION SELECT center, s, 'broken_follows' FROM links l WHERE p = 'follows' AND NOT EXISTS (FROM nodes n WHERE n.center = l.center AND n.node = l.o)
    )"""


def planted_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the users' subgraphs."""
    e = T.episodes(spark, sf_dir).withColumn("center", F.col("user"))
    none = F.lit(None).cast("string")
    nodes = e.select("center", F.col("user").alias("node"), none.alias("content")).unionByName(e.select("center", F.col("session").alias("node"), none.alias("content")))
    nodes = nodes.unionByName(e.select("center", F.col("id").alias("node"), F.col("summary").alias("content")))
    nodes = nodes.unionByName(e.select("center", F.concat(F.lit("D:"), "id").alias("node"), F.regexp_extract("reply", "^[^.]*", 0).alias("content")))
    nodes = nodes.unionByName(e.select("center", F.explode("entities").alias("_e")).select("center", F.concat(F.lit("E:"), "_e").alias("node"), none.alias("content"))).distinct()
    edge = lambda df, s, p, o: df.select("center", s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    c = F.col
    links = edge(e, c("user"), "has_session", c("session")).unionByName(edge(e, c("id"), "in_session", c("session"))).unionByName(edge(e, c("id"), "has_decision", F.concat(F.lit("D:"), "id")))
    links = links.unionByName(edge(e.where("follows IS NOT NULL"), c("id"), "follows", c("follows")))
    return nodes, links.unionByName(edge(e.withColumn("_e", F.explode("entities")), c("id"), "has_entity", F.concat(F.lit("E:"), "_e"))).distinct()


@query("WITH " + T.EPISODES_SQL + """, c AS (SELECT DISTINCT "user" AS center FROM episodes), k AS (SELECT unnest([""" + ", ".join(f"'{k}'" for k in J.KINDS) + """]) AS kind)
    SELECT center, kind FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY sha256('7|' || center || '|' || kind)) AS r FROM c, k) WHERE r <= ('0x' || substr(sha256('7|' || center), 1, 8))::BIGINT % 10""")
def anomaly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of anomaly that each user's subgraph is to get: none to all nine, seeded."""
    return J.requested(T.episodes(spark, sf_dir).select(F.col("user").alias("center")), 7)


@query("WITH " + _PLANTED_SQL + " FROM found")
def clean_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nine rules find before anything is planted."""
    return J.detect(*planted_graph(spark, sf_dir))


@query()
def injected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted anomalies of all nine kinds against what the rules find, per kind."""
    nodes, edges = planted_graph(spark, sf_dir)
    wanted = J.requested(T.episodes(spark, sf_dir).select(F.col("user").alias("center")), 7)
    after, linked, planted = J.inject(nodes, edges, wanted, 7)
    return J.recall_by_kind(planted, J.detect(after, linked)).select("kind", "planted", "detected", F.round("recall", 6).alias("recall"))


@query("WITH " + _PLANTED_SQL + """, drift AS (SELECT center, o AS node, 'identity_drift' AS kind FROM links WHERE p = 'has_entity' GROUP BY center, o HAVING count(*) >= 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY sha256('5|' || node || '|' || kind)) AS r FROM drift), kept AS (SELECT center, node, kind FROM ranked WHERE r <= 2),
    others AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY sha256('5|' || node || '|' || kind)) AS r FROM found)
    FROM kept UNION ALL SELECT center, node, kind FROM others LEFT JOIN (SELECT center, count(*) AS used FROM kept GROUP BY center) USING (center) WHERE r <= 4 - coalesce(used, 0)""")
def decision_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four findings of each user to decide: half for names that wander between episodes, the rest for anomalies."""
    nodes, edges = planted_graph(spark, sf_dir)
    drift = edges.where("p = 'has_entity'").groupBy("center", F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return J.decision_budget(drift, J.detect(nodes, edges), 4, 5)
