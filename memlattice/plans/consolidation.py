"""Consolidation queries: anomalies, contradictions, decay, lifecycle, near duplicates of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import scoring as S
from memlattice.functions import text as X
from memlattice.operators import graph as G
from memlattice.operators import lifecycle as L
from memlattice.operators import overlap as V
from memlattice.plans.retrieval import entity_salience
from memlattice.registry import query
from memlattice.sources import tables as T

_A = "WITH " + T.ASSERTIONS_SQL


@query(_A + " SELECT entity, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value)), ',') AS value_list, arg_min(asserted_by, (asserted_at, asserted_by)) AS oldest, arg_max(asserted_by, (asserted_at, asserted_by)) AS newest FROM assertions GROUP BY entity HAVING count(DISTINCT value) > 1")
def contradictory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with several values, resolved to their oldest and newest assertion."""
    c = L.contradictions(T.assertions(spark, sf_dir))
    return c.select("entity", "n_values", F.array_join("values", ",").alias("value_list"), "oldest", "newest")


@query(_A + " SELECT entity, value, arg_max(asserted_by, (asserted_at, asserted_by)) AS asserted_by FROM assertions GROUP BY ALL")
def assertion_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-asserted values keep their newest provenance."""
    return L.latest_assertion(T.assertions(spark, sf_dir)).select("entity", "value", "asserted_by")


@query(_A + """, changed AS (
        SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY asserted_at, asserted_by) AS before FROM assertions) WHERE before IS NULL OR before <> value
    ) SELECT entity, value, asserted_by, lead(asserted_by) OVER (PARTITION BY entity ORDER BY asserted_at, asserted_by) AS superseded_by FROM changed""")
def superseded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts closed by the next different assertion of their entity."""
    return L.validity_intervals(T.assertions(spark, sf_dir)).select("entity", "value", "asserted_by", "superseded_by")


@query("WITH RECURSIVE ratings AS (SELECT 'u' || (user_id % 60) AS unit, event_id AS position, CAST(floor(value) AS BIGINT) % 7 AS rating FROM events), kept AS (SELECT unit, rating, row_number() OVER (PARTITION BY unit ORDER BY position) AS r FROM ratings WHERE rating BETWEEN 1 AND 5), fold AS (SELECT DISTINCT unit, 0::BIGINT AS r, 1.0::DOUBLE AS v FROM kept UNION ALL SELECT f.unit, k.r, least(4.0::DOUBLE, greatest(0.25::DOUBLE, f.v * (0.5::DOUBLE + (k.rating - 1) / 4.0::DOUBLE))) FROM fold f JOIN kept k ON k.unit = f.unit AND k.r = f.r + 1) SELECT unit, round(arg_max(v, r), 6) AS value, max(r) AS n FROM fold GROUP BY unit")
def feedback_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings compounded in order, clamped at every step."""
    e = T.table(spark, sf_dir, "events")
    ratings = e.select(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("unit"), F.col("event_id").alias("position"), (F.floor("value") % 7).alias("rating"))
    return L.compounded_boost(ratings).select("unit", F.round("value", 6).alias("value"), "n")


def _retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").where("event_type = 'view'")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select(F.concat(F.lit("U:"), (F.col("user_id") % 50).cast("string")).alias("edge"), seconds.alias("seconds"), F.lit(1.0).alias("modifier"), "event_id")


_RETRIEVALS_SQL = "retrievals AS (SELECT 'U:' || (user_id % 50) AS edge, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000000 AS seconds, event_id FROM events WHERE event_type = 'view')"


@query("WITH " + _RETRIEVALS_SQL + " SELECT edge, event_id, count(*) OVER (PARTITION BY edge ORDER BY seconds RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_day FROM retrievals")
def retrievals_in_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievals of an edge within the day before each retrieval."""
    return L.counted_before(_retrievals(spark, sf_dir)).select("edge", "event_id", F.col("recent").alias("in_day"))


@query("WITH RECURSIVE " + _RETRIEVALS_SQL + """, n AS (SELECT edge, row_number() OVER w AS i, count(*) OVER (PARTITION BY edge ORDER BY seconds RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM retrievals WINDOW w AS (PARTITION BY edge ORDER BY seconds)),
    f AS (SELECT DISTINCT edge, 0::BIGINT AS i, 0.01::DOUBLE AS rate FROM n
          UNION ALL SELECT f.edge, n.i, greatest(0.001::DOUBLE, CASE WHEN n.recent > 5 THEN least(0.05::DOUBLE, f.rate * 1.02::DOUBLE) ELSE f.rate * (1 - 0.05::DOUBLE / (1 + 0.3::DOUBLE * (n.i - 1))) END) FROM f JOIN n ON n.edge = f.edge AND n.i = f.i + 1)
    SELECT edge, round(arg_max(rate, i), 8) AS rate, max(i) AS n FROM f GROUP BY edge""")
def retrieval_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay rate of every edge after its retrievals, in order."""
    return L.retrieval_fold(_retrievals(spark, sf_dir)).withColumn("rate", F.round("rate", 8))


@query("WITH " + _RETRIEVALS_SQL + """, r AS (SELECT edge, seconds / 86400.0::DOUBLE AS d FROM retrievals), n AS (SELECT max(d) AS now FROM r), g AS (
        SELECT edge, max(d) AS last, least(1.0::DOUBLE, sum(pow(0.5::DOUBLE, (now - d) / 7.0::DOUBLE)) / 10.0::DOUBLE) AS access, count(*) AS c, min(now) AS now FROM r, n GROUP BY edge
    ) SELECT edge, round(greatest(0.001::DOUBLE, 0.01::DOUBLE + 0.01::DOUBLE * pow(0.5::DOUBLE, (now - last) / 7.0::DOUBLE)), 6) AS new_rate,
        round(pow(1 - greatest(0.001::DOUBLE, 0.01::DOUBLE + 0.01::DOUBLE * pow(0.5::DOUBLE, (now - last) / 7.0::DOUBLE)), now - last), 6) AS new_score,
        round(0.4::DOUBLE * access + 0.6::DOUBLE * (c % 10) / 40.0::DOUBLE, 6) AS utility, 0.4::DOUBLE * access + 0.6::DOUBLE * (c % 10) / 40.0::DOUBLE < 0.1 AS archive FROM g""")
def dream_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay, utility and soft-archive decision of every association edge."""
    r = _retrievals(spark, sf_dir).select("edge", (F.col("seconds") / F.lit(86400.0)).alias("at"))
    now = F.broadcast(r.agg(F.max("at").alias("_now")))
    g = r.crossJoin(now).groupBy("edge").agg(
        F.max("at").alias("last"), F.max("_now").alias("_now"), S.access_frequency(F.col("_now") - F.col("at")).alias("access"),
        ((F.count(F.lit(1)) % 10) / F.lit(40.0)).alias("structural"),
    )
    g = g.select("*", F.lit(1.0).alias("score"), F.lit(0.02).alias("rate"), F.lit(0.01).alias("base_rate"))
    d = L.dream(g, F.col("_now"))
    return d.select("edge", F.round("new_rate", 6).alias("new_rate"), F.round("new_score", 6).alias("new_score"), F.round("utility", 6).alias("utility"), "archive")


@query("WITH " + T.EDGES_SQL + """, tok AS (SELECT id, conv_id, list_distinct(regexp_extract_all(lower(summary), '[0-9a-z]+')) AS t FROM episodes)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE, 6) AS similarity
    FROM tok a JOIN tok b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE >= 0.3""")
def similar_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of episodes whose summary token sets are similar: an exact join in blocks."""
    e = T.episodes(spark, sf_dir).select("id", X.word_tokens(F.col("summary")).alias("items"))
    similarity = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    pairs = V.overlapping_pairs(e, ratio=0.3).select("a", "b", similarity.alias("_s")).where("_s >= 0.3")
    return pairs.select("a", "b", F.round("_s", 6).alias("similarity"))


@query("WITH " + T.EDGES_SQL + " SELECT s, o FROM edges WHERE p = 'follows' AND o NOT IN (SELECT id FROM episodes WHERE length(reply) >= 300)")
def broken_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows edges to episodes that are missing from the kept set."""
    e = T.episodes(spark, sf_dir)
    known = e.where(F.length("reply") >= 300).select(F.col("id").alias("node"))
    return G.without_match(T.edges(spark, sf_dir), "follows", known).select("s", "o")


@query("WITH " + T.EDGES_SQL + ", d AS (SELECT o AS node, count(*) AS n FROM edges WHERE p = 'has_topic' GROUP BY o) SELECT id FROM episodes WHERE id NOT IN (SELECT s FROM edges JOIN d ON d.node = o WHERE p = 'has_topic' AND n > 1)")
def orphan_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that share no topic with another."""
    e = T.episodes(spark, sf_dir)
    topic = T.edges(spark, sf_dir).where("p = 'has_topic'")
    shared = topic.groupBy("o").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    linked = topic.join(shared, "o", "left_semi").select(F.col("s").alias("id"))
    return e.select("id").join(linked, "id", "left_anti")


@query("WITH " + T.EDGES_SQL + """, t AS (SELECT e.o AS entity, e.s AS ep, x.o AS topic FROM edges e JOIN edges x ON x.s = e.s AND x.p = 'has_topic' WHERE e.p = 'has_entity')
    SELECT entity, count(DISTINCT ep) AS n_episodes FROM t GROUP BY entity HAVING count(DISTINCT ep) >= 2 AND count(DISTINCT topic) = count(*)""")
def identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose episodes' topic sets are pairwise disjoint."""
    edges = T.edges(spark, sf_dir)
    ent = edges.where("p = 'has_entity'").select("s", F.col("o").alias("entity"))
    top = edges.where("p = 'has_topic'").select("s", F.col("o").alias("topic"))
    g = ent.join(top, "s").groupBy("entity").agg(F.countDistinct("s").alias("n_episodes"), F.countDistinct("topic").alias("_t"), F.count(F.lit(1)).alias("_all"))
    return g.where("n_episodes >= 2 AND _t = _all").select("entity", "n_episodes")


@query("WITH " + T.EDGES_SQL + """, seen AS (SELECT edges.o AS entity, count(*) AS c FROM edges WHERE p = 'has_entity' GROUP BY edges.o), top AS (SELECT o, count(*) AS c FROM edges WHERE p = 'has_topic' GROUP BY o)
    SELECT e.s, e.o, t.o AS topic FROM edges e JOIN seen ON seen.entity = e.o AND seen.c = 1 JOIN edges t ON t.s = e.s AND t.p = 'has_topic' JOIN top ON top.o = t.o AND top.c = 1 WHERE e.p = 'has_entity'""")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations whose both ends are mentioned once."""
    edges = T.edges(spark, sf_dir)
    once = lambda p: edges.where(F.col("p") == p).groupBy("o").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("o")
    e = edges.where("p = 'has_entity'").join(once("has_entity"), "o", "left_semi").select("s", "o")
    t = edges.where("p = 'has_topic'").join(once("has_topic"), "o", "left_semi").select("s", F.col("o").alias("topic"))
    return e.join(t, "s").select("s", "o", "topic")


@query("WITH " + T.EDGES_SQL + ", top AS (SELECT o, count(*) AS n FROM edges WHERE p = 'has_entity' GROUP BY o), r AS (SELECT *, rank() OVER (ORDER BY n DESC, o) AS rank FROM top) SELECT o AS node, n, rank FROM r WHERE rank <= 20")
def shared_entities_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most shared entities (a top-k report)."""
    n = T.edges(spark, sf_dir).where("p = 'has_entity'").groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "node").limit(20)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"), "node")).cast("long"))


@query("WITH " + T.EDGES_SQL + """, m AS (SELECT o AS entity, count(*) AS n FROM edges WHERE p = 'has_entity' GROUP BY o)
    SELECT least(n, 10) AS bucket, count(*) AS n_entities FROM m GROUP BY 1""")
def mention_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by mention count, ten and more together."""
    m = T.edges(spark, sf_dir).where("p = 'has_entity'").groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy(F.least("n", F.lit(10)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n_entities"))


_SCORES_SQL = "scores AS (SELECT event_id, value / 500.0::DOUBLE AS score FROM events)"


@query("WITH " + _SCORES_SQL + " SELECT least(CAST(floor(score * 100) AS BIGINT), 99) AS bin, count(*) AS n FROM scores WHERE score >= 0.05 GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundred bins of scores above a floor; 1.0 is in the last bin."""
    s = T.table(spark, sf_dir, "events").select((F.col("value") / 500.0).alias("score")).where("score >= 0.05")
    return s.groupBy(F.least(F.floor(F.col("score") * 100), F.lit(99)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _SCORES_SQL + ", b AS (SELECT least(CAST(floor(score * 100) AS BIGINT), 99) AS bin, count(*) AS n FROM scores GROUP BY 1) SELECT bin, n, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS above FROM b")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or above every bin, cumulated over the hundred bins."""
    s = T.table(spark, sf_dir, "events").select((F.col("value") / 500.0).alias("score"))
    b = s.groupBy(F.least(F.floor(F.col("score") * 100), F.lit(99)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("bin"))))


@query("WITH " + _SCORES_SQL + " SELECT CASE WHEN score >= 0.85 THEN 'propose' WHEN score >= 0.60 THEN 'verify' ELSE 'skip' END AS tier, count(*) AS n, round(min(score), 6) AS least FROM scores GROUP BY 1")
def link_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-prediction tiers: propose, verify, skip."""
    s = T.table(spark, sf_dir, "events").select((F.col("value") / 500.0).alias("score"))
    tier = F.when(F.col("score") >= 0.85, "propose").when(F.col("score") >= 0.60, "verify").otherwise("skip")
    return s.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"))


@query(_A + ", c AS (SELECT max(asserted_at) AS now FROM assertions) SELECT value, CAST(min(date_diff('microsecond', asserted_at, now)) // 86400000000 AS BIGINT) AS idle_days, min(date_diff('microsecond', asserted_at, now)) // 86400000000 >= 5 AS decays FROM assertions, c GROUP BY value")
def class_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by whole days since they were last seen."""
    a = T.assertions(spark, sf_dir)
    now = F.broadcast(a.agg(F.max("asserted_at").alias("_now")))
    idle = F.min(F.floor(S.days_between(F.col("_now"), F.col("asserted_at"))))
    g = a.crossJoin(now).groupBy("value").agg(idle.alias("idle_days"))
    return g.withColumn("decays", F.col("idle_days") >= 5)


@query("WITH " + T.EDGES_SQL + """, h AS (SELECT s AS node, o AS nb FROM edges WHERE p = 'follows' UNION SELECT o, s FROM edges WHERE p = 'follows')
    SELECT session AS component, count(*) AS n FROM episodes GROUP BY session HAVING count(*) >= 2""")
def isolated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of follows with two nodes or more, named by their session."""
    e = T.episodes(spark, sf_dir)
    links = T.edges(spark, sf_dir).where("p = 'follows'").select("s", "o")
    labels = G.propagate_labels(links)
    return labels.join(e.select(F.col("id").alias("node"), "session"), "node").groupBy("component").agg(F.min("session").alias("_s"), F.count(F.lit(1)).alias("n")).select(F.col("_s").alias("component"), "n")
