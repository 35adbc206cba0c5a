"""Retrieval queries: scans, axes, hops, filters, scoring and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import scoring as S
from memlattice.functions import text as X
from memlattice.operators import graph as G
from memlattice.operators import overlap as V
from memlattice.operators import retrieval as R
from memlattice.plans.units import _STATES_SQL as STATES_SQL
from memlattice.plans.units import units
from memlattice.registry import query
from memlattice.sources import tables as T
from memlattice.sources.sinks import materialised

#: Plans of the retrieval queries: the most mentioned entities, paired.
_PLAN_SQL = """, popular AS (
        SELECT substr(o, 3) AS name, row_number() OVER (ORDER BY count(*) DESC, o) AS r FROM edges WHERE p = 'has_entity' GROUP BY o
    ), topic AS (
        SELECT substr(o, 3) AS name, row_number() OVER (ORDER BY count(*) DESC, o) AS r FROM edges WHERE p = 'has_topic' GROUP BY o
    ), plans AS (
        SELECT 'q' || a.r AS query_id, a.name AS e1, b.name AS e2, t.name AS t1, CASE WHEN a.r % 2 = 0 THEN 'intersection' ELSE 'union' END AS entity_mode
        FROM popular a JOIN popular b ON b.r = a.r + 1 JOIN topic t ON t.r = a.r WHERE a.r <= 20
    ), axes AS (
        SELECT query_id, 'has_entity' AS p, 'E:' || e AS o, CASE WHEN entity_mode = 'intersection' THEN 2 ELSE 1 END AS need FROM plans, (SELECT unnest([1, 2]) AS k), LATERAL (SELECT CASE k WHEN 1 THEN e1 ELSE e2 END AS e)
        UNION ALL SELECT query_id, 'has_topic', 'T:' || t1, 1 FROM plans WHERE query_id IN ('q3', 'q6', 'q9')
    ), met AS (
        SELECT query_id, s, axes.p, count(DISTINCT axes.o) AS n, max(need) AS need FROM axes JOIN edges ON edges.p = axes.p AND edges.o = axes.o GROUP BY ALL
    ), candidates AS (
        SELECT query_id, s AS id FROM met WHERE n >= need GROUP BY query_id, s
        HAVING count(*) = (SELECT count(DISTINCT p) FROM axes a WHERE a.query_id = met.query_id)
    )"""


def _popular(edges: DataFrame, predicate: str, n: int) -> DataFrame:
    counts = edges.where(F.col("p") == predicate).groupBy("o").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), "o").limit(n)  # the feature: plans for the n most mentioned
    return top.select(F.substring("o", 3, 1000).alias("name"), F.row_number().over(Window.orderBy(F.desc("_n"), "o")).alias("r"))


def plans(edges: DataFrame) -> DataFrame:
    """Twenty plans over the most mentioned entities and topics."""
    a = _popular(edges, "has_entity", 21)
    b = a.select(F.col("name").alias("second"), (F.col("r") - 1).alias("r"))
    t = _popular(edges, "has_topic", 21).select(F.col("name").alias("topic"), "r")
    twenty = a.join(b, "r").join(t, "r").where("r <= 20").select(
        F.concat(F.lit("q"), F.col("r").cast("string")).alias("query_id"),
        F.array("name", "second").alias("entities"),
        F.when(F.col("r").isin(3, 6, 9), F.array("topic")).otherwise(F.array().cast("array<string>")).alias("topics"),
        F.array().cast("array<string>").alias("tones"),
        F.when(F.col("r") % 2 == 0, "intersection").otherwise("union").alias("entity_mode"),
    )
    return materialised(twenty)


@query("WITH " + T.EPISODES_SQL + " SELECT id, session, \"user\", len(entities) AS n_entities, len(topics) AS n_topics, len(tones) AS n_tones, follows, length(summary) AS n_summary FROM episodes")
def episodes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with the sizes of their axes."""
    e = T.episodes(spark, sf_dir)
    size = lambda c: F.size(c).cast("long")
    return e.select("id", "session", "user", size("entities").alias("n_entities"), size("topics").alias("n_topics"), size("tones").alias("n_tones"), "follows", F.length("summary").cast("long").alias("n_summary"))


@query("WITH " + T.EDGES_SQL + " SELECT p, count(*) AS n_edges, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM edges GROUP BY p")
def edges_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple expansion: edges, subjects and objects per predicate."""
    return T.edges(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


@query("WITH " + T.EDGES_SQL + " SELECT s, p, o FROM edges WHERE p = 'has_entity' AND o >= 'E:T' AND o < 'E:U'")
def edges_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range scan over entity edges by object prefix."""
    return T.edges(spark, sf_dir).where("p = 'has_entity' AND o >= 'E:T' AND o < 'E:U'").select("s", "p", "o")


@query("WITH " + T.EDGES_SQL + _PLAN_SQL + " SELECT query_id, id FROM candidates")
def axis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: union inside an axis, intersection across axes and in intersection mode."""
    edges = T.edges(spark, sf_dir)
    return G.axis_candidates(R.plan_axes(plans(edges)), edges)


def entity_salience(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(entity, mentions, value) with recency measured from the newest episode."""
    newest = episodes.agg(F.max("ts").alias("_now"))
    seen = edges.where("p = 'has_entity'").join(episodes.select(F.col("id").alias("s"), "ts"), "s")
    stats = seen.groupBy("o").agg(F.count(F.lit(1)).alias("mentions"), F.max("ts").alias("last")).crossJoin(F.broadcast(newest))
    value = S.entity_salience(F.col("mentions"), F.lit(None).cast("double"), S.days_between(F.col("_now"), F.col("last")))
    return stats.select(F.col("o").alias("entity"), "mentions", value.alias("value"))


_SALIENCE_SQL = """, seen AS (
        SELECT edges.o, count(*) AS mentions, max(ts) AS last FROM edges JOIN episodes ON edges.s = id WHERE p = 'has_entity' GROUP BY edges.o
    ), salience AS (
        SELECT o AS entity, mentions, least(1.0::DOUBLE, 0.1::DOUBLE + 0.03::DOUBLE * sqrt(mentions::DOUBLE))
               * pow(0.5::DOUBLE, (epoch_us((SELECT max(ts) FROM episodes)) - epoch_us(last)) / 86400000000.0::DOUBLE / 30.0::DOUBLE) AS value FROM seen
    )"""


@query("WITH " + T.EDGES_SQL + _SALIENCE_SQL + " SELECT entity, mentions, round(value, 6) AS value FROM salience")
def salience_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity salience from mention counts and the newest mention."""
    e = T.episodes(spark, sf_dir)
    return entity_salience(T.edges(spark, sf_dir), e).select("entity", "mentions", F.round("value", 6).alias("value"))


@query("WITH " + T.EDGES_SQL + _PLAN_SQL + _SALIENCE_SQL + """, matched AS (
        SELECT c.query_id, c.id, sum(CASE WHEN e.p = 'has_entity' THEN 10.0::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(value, 0)) WHEN e.p = 'has_topic' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END) AS m
        FROM candidates c JOIN edges e ON e.s = c.id JOIN (SELECT DISTINCT query_id, p, o FROM axes) a ON a.query_id = c.query_id AND a.p = e.p AND a.o = e.o
        LEFT JOIN salience ON entity = e.o GROUP BY ALL
    ), scored AS (
        SELECT c.query_id, c.id, coalesce(m, 0) + 0.1::DOUBLE * (row_number() OVER (PARTITION BY c.query_id ORDER BY ts, c.id) - 1) AS score
        FROM candidates c JOIN episodes ep ON ep.id = c.id LEFT JOIN matched ON matched.query_id = c.query_id AND matched.id = c.id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored
    ) SELECT query_id, rank, id, round(score, 5) AS score FROM ranked WHERE rank <= 5""")
def retrieve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five episodes of every plan by entity, topic and recency score."""
    e = T.episodes(spark, sf_dir)
    edges = T.edges(spark, sf_dir)
    found = R.retrieve(plans(edges), e, edges, entity_salience(edges, e))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 5).alias("score"))


_UNITS_SQL = T.EDGES_SQL + ", " + T.DOCUMENT_EDGES_SQL + STATES_SQL[len(T.EPISODES_SQL) :] + _PLAN_SQL[: _PLAN_SQL.index(", met AS")] + _SALIENCE_SQL + """, whole AS (
        SELECT s, p, o FROM edges UNION ALL SELECT s, p, o FROM document_edges WHERE p = 'has_entity' AND s LIKE '%\\_sec\\_%' ESCAPE '\\'
    ), met AS (
        SELECT query_id, s, axes.p, count(DISTINCT axes.o) AS n, max(need) AS need FROM axes JOIN whole ON whole.p = axes.p AND whole.o = axes.o GROUP BY ALL
    ), candidates AS (
        SELECT query_id, s AS id FROM met WHERE n >= need AND s NOT IN (SELECT id FROM units WHERE NOT (coalesce(state, 'current') = 'current' AND validity_end IS NULL))
        GROUP BY query_id, s HAVING count(*) = (SELECT count(DISTINCT p) FROM axes a WHERE a.query_id = met.query_id)
    ), timed AS (
        SELECT id, ts FROM episodes UNION ALL SELECT section, TIMESTAMP '2026-07-01 00:00:00' + to_seconds(substr(doc, 5)::BIGINT * 60) FROM sections
    ), matched AS (
        SELECT c.query_id, c.id, sum(CASE WHEN e.p = 'has_entity' THEN 10.0::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(value, 0)) WHEN e.p = 'has_topic' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END) AS m
        FROM candidates c JOIN whole e ON e.s = c.id JOIN (SELECT DISTINCT query_id, p, o FROM axes) a ON a.query_id = c.query_id AND a.p = e.p AND a.o = e.o
        LEFT JOIN salience ON entity = e.o GROUP BY ALL
    ), scored AS (
        SELECT c.query_id, c.id, coalesce(m, 0) + 0.1::DOUBLE * (row_number() OVER (PARTITION BY c.query_id ORDER BY ts, c.id) - 1) AS score
        FROM candidates c JOIN timed t ON t.id = c.id LEFT JOIN matched ON matched.query_id = c.query_id AND matched.id = c.id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored
    )"""


@query("WITH " + _UNITS_SQL + " SELECT query_id, rank, id, round(score, 5) AS score FROM ranked WHERE rank <= 5")
def retrieve_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five units in force of every plan: episodes and sections of documents together."""
    e, edges = T.episodes(spark, sf_dir), T.edges(spark, sf_dir)
    named = T.document_edges(spark, sf_dir).where("p = 'has_entity' AND contains(s, '_sec_')")
    taken = F.expr(f"timestamp_seconds(unix_seconds(timestamp'{T.EPOCH}') + cast(substring(doc, 5) AS long) * 60)")
    timed = e.select("id", "ts").unionByName(T.sections(spark, sf_dir).select(F.col("section").alias("id"), taken.alias("ts")))
    found = R.retrieve(plans(edges), timed, edges.unionByName(named), entity_salience(edges, e), states=units(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 5).alias("score"))


@query("WITH " + T.EDGES_SQL + " SELECT a.s AS id, b.s AS related, count(*) AS shared FROM edges a JOIN edges b ON a.o = b.o AND a.p = b.p WHERE a.p = 'has_topic' AND a.s < b.s GROUP BY ALL HAVING count(*) >= 4")
def related_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of episodes that share at least four topics: an exact join in blocks."""
    lists = T.edges(spark, sf_dir).where("p = 'has_topic'").groupBy(F.col("s").alias("id")).agg(F.collect_set("o").alias("items"))
    return V.overlapping_pairs(lists, least=4).select(F.col("a").alias("id"), F.col("b").alias("related"), F.col("common").alias("shared"))


@query("WITH RECURSIVE " + T.EDGES_SQL + """, walk AS (
        SELECT id AS anchor, id AS node, 0 AS hop FROM episodes
        UNION ALL SELECT anchor, edges.o, hop + 1 FROM walk JOIN edges ON edges.s = node AND p = 'follows' WHERE hop < 5
    ) SELECT anchor, node, hop FROM walk""")
def follow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hops along follows from every episode."""
    e = T.episodes(spark, sf_dir)
    return G.chain(e.select(F.col("id").alias("node")), T.edges(spark, sf_dir), "follows", 5)


@query("WITH " + T.EDGES_SQL + """, hops AS (
        SELECT s AS node, o AS nb FROM edges WHERE p IN ('in_session', 'has_session', 'follows') UNION SELECT o, s FROM edges WHERE p IN ('in_session', 'has_session', 'follows')
    ), centers AS (SELECT DISTINCT s AS c FROM edges WHERE p = 'has_session'), d0 AS (SELECT c, c AS node, 0 AS depth FROM centers),
    d1 AS (SELECT c, nb AS node, 1 AS depth FROM d0 JOIN hops USING (node)),
    d2 AS (SELECT DISTINCT c, nb AS node, 2 AS depth FROM d1 JOIN hops USING (node)),
    a AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)
    SELECT c AS center, node, min(depth) AS depth FROM a GROUP BY c, node""")
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius-two subgraphs around all users, with least depths."""
    edges = T.edges(spark, sf_dir)
    centers = edges.where("p = 'has_session'").select(F.col("s").alias("node")).distinct()
    return G.bounded_bfs(centers, G.undirected(edges, ["in_session", "has_session", "follows"]), 2, both_ways=True)


@query("WITH " + T.EDGES_SQL + """, hops AS (
        SELECT s AS node, o AS nb FROM edges WHERE p = 'has_topic' UNION SELECT o, s FROM edges WHERE p = 'has_topic'
    ) SELECT node, nb FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nb) AS r FROM hops) WHERE r <= 8""")
def neighbours_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic neighbourhoods cut to the first eight by id."""
    return G.capped(G.undirected(T.edges(spark, sf_dir), ["has_topic"]), 8)


@query("WITH " + T.EDGES_SQL + """ SELECT id, coalesce(array_to_string(list_sort(list(o) FILTER (p = 'has_entity')), ','), '') AS entities, coalesce(array_to_string(list_sort(list(o) FILTER (p = 'has_tone')), ','), '') AS tones, count(*) FILTER (p = 'has_topic') AS n_topics,
    max(o) FILTER (p = 'in_session') AS session FROM episodes JOIN edges ON s = id GROUP BY id""")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each episode bucketed by predicate in one pass."""
    e = T.edges(spark, sf_dir).where("s LIKE 'ep\\_%'")
    pick = lambda p: F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") == p, F.col("o")))), ",")
    return e.groupBy(F.col("s").alias("id")).agg(
        pick("has_entity").alias("entities"), pick("has_tone").alias("tones"), F.count(F.when(F.col("p") == "has_topic", 1)).alias("n_topics"), F.max(F.when(F.col("p") == "in_session", F.col("o"))).alias("session")
    )


@query("WITH " + T.EPISODES_SQL + """, now AS (SELECT max(ts) AS now FROM episodes) SELECT id,
    ts >= now - INTERVAL 1 DAY AS today, ts >= now - INTERVAL 7 DAY AS this_week, ts >= now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY AS last_week, ts >= now - INTERVAL 30 DAY AS this_month FROM episodes, now""")
def temporal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative time buckets against an explicit now."""
    e = T.episodes(spark, sf_dir)
    now = F.col("now")
    since = lambda days: F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select(
        "id", since(1).alias("today"), since(7).alias("this_week"), (since(14) & ~since(7)).alias("last_week"), since(30).alias("this_month")
    )


@query("WITH " + T.EPISODES_SQL + " SELECT id FROM episodes WHERE ts >= TIMESTAMP '2026-07-02 00:00:00' AND ts <= TIMESTAMP '2026-07-05 00:00:00'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute range, both ends included; a bare date is its midnight."""
    return T.episodes(spark, sf_dir).where("ts >= timestamp'2026-07-02 00:00:00' AND ts <= timestamp'2026-07-05 00:00:00'").select("id")


@query("WITH " + T.EPISODES_SQL + " SELECT session, min_by(id, ts) AS anchor FROM episodes WHERE contains(lower(summary), 'the') GROUP BY session")
def keyword_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest episode of a session whose summary has a keyword."""
    return T.episodes(spark, sf_dir).where(F.lower("summary").contains("the")).groupBy("session").agg(F.min_by("id", "ts").alias("anchor"))


@query("WITH " + T.EPISODES_SQL + """, costs AS (
        SELECT session, id, ts, length(summary) // 4 + 10 AS tokens FROM episodes
    ), used AS (
        SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS used FROM costs
    ) SELECT session, id, tokens, used::BIGINT AS used FROM used WHERE used <= 150""")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context packing that stops at the first overflow."""
    rows = T.episodes(spark, sf_dir).select("session", "id", "ts", (X.token_estimate(F.col("summary")) + 10).alias("tokens"))
    return R.packed_prefix(rows, "session", [F.col("ts"), F.col("id")], "tokens", 150).select("session", "id", "tokens", "used")


@query("WITH RECURSIVE " + T.EPISODES_SQL + """, costs AS (
        SELECT session, id, length(reply) // 4 AS cost, row_number() OVER (PARTITION BY session ORDER BY turn) AS pos FROM episodes
    ), fold AS (
        SELECT session, 0 AS pos, 0::BIGINT AS used, []::VARCHAR[] AS ids FROM (SELECT DISTINCT session FROM costs)
        UNION ALL
        SELECT f.session, c.pos, CASE WHEN f.used + c.cost <= 700 AND len(ids) < 4 THEN f.used + c.cost ELSE f.used END,
               CASE WHEN f.used + c.cost <= 700 AND len(ids) < 4 THEN list_append(ids, c.id) ELSE ids END
        FROM fold f JOIN costs c ON c.session = f.session AND c.pos = f.pos + 1
    ) SELECT session, array_to_string(arg_max(ids, pos), ',') AS ids, arg_max(used, pos) AS used FROM fold GROUP BY session""")
def context_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context packing that skips what does not fit, four units at most."""
    e = T.episodes(spark, sf_dir)
    rows = e.select("session", F.col("turn").alias("position"), "id", X.token_estimate(F.col("reply")).alias("cost"))
    return R.packed_skip(rows, "session", "cost", 700, 4).select("session", F.array_join("ids", ",").alias("ids"), "used")


@query("WITH " + T.EDGES_SQL + ", degree AS (SELECT node, count(*) AS degree FROM (SELECT unnest([s, o]) AS node FROM edges) GROUP BY node) SELECT node, degree FROM degree WHERE degree >= 5")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of at least five over all predicates."""
    return G.degrees(T.edges(spark, sf_dir)).where("degree >= 5")


@query("WITH " + T.EDGES_SQL + """, kinds AS (SELECT DISTINCT unnest([s, o]) AS node FROM edges)
    SELECT CASE WHEN node LIKE 'E:%' THEN 'entity' WHEN node LIKE 'T:%' THEN 'topic' WHEN node LIKE 'A:%' THEN 'tone' WHEN node LIKE 'S:%' THEN 'session' WHEN node LIKE 'U:%' THEN 'user' ELSE 'episode' END AS kind, count(*) AS n FROM kinds GROUP BY 1""")
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nodes by kind inferred from their ids."""
    nodes = T.edges(spark, sf_dir).select(F.explode(F.array("s", "o")).alias("node")).distinct()
    return nodes.groupBy(X.node_kind(F.col("node")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + T.EDGES_SQL + """, base AS (SELECT 'q' || ((conv_id % 30)::VARCHAR) AS query_id, id, CASE WHEN turn % 4 = 0 THEN 'episode' ELSE 'memory' END AS kind, conv_id FROM episodes)
    SELECT query_id, kind, count(*) AS n FROM base GROUP BY ALL""")
def diversity_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds per query ahead of the diversity rerank."""
    return _mixed(spark, sf_dir).groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.episodes(spark, sf_dir)
    return e.select(
        F.concat(F.lit("q"), (F.col("conv_id") % 30).cast("string")).alias("query_id"), "id",
        F.when(F.col("turn") % 4 == 0, "episode").otherwise("memory").alias("kind"), F.length("reply").cast("double").alias("score"),
    )


@query()
def diversity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three results of one kind in a row."""
    return R.diverse(_mixed(spark, sf_dir))
