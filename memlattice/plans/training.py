"""Queries of training data and metrics: rings as of a turn, traces, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators import losses as L
from memlattice.operators import ring as R
from memlattice.operators.evaluation import placed_values
from memlattice.plans.streams import turn_sources
from memlattice.registry import query
from memlattice.sources import tables as T

#: Touches are the names of a turn, scored by the documents that have the name; the ring has eight.
_RING_SQL = """
    WITH named AS (
        SELECT 'S:' || conv_id AS session, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS source, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{5,}'), 1) AS p FROM conversations
    ), found AS (
        SELECT source, count(*) AS score FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS source FROM documents) GROUP BY source
    ), touched AS (
        SELECT session, turn, source, row_number() OVER (PARTITION BY session ORDER BY turn, min(p)) - 1 AS slot, row_number() OVER (PARTITION BY session, turn ORDER BY min(p)) - 1 AS rank FROM named GROUP BY session, turn, source
    ), scored AS (
        SELECT touched.*, coalesce(score, 0) AS score FROM touched LEFT JOIN found USING (source)
    ), asked AS (
        SELECT 'S:' || conv_id AS session, turn, (SELECT count(*) FROM touched WHERE touched.session = 'S:' || conv_id AND touched.turn < c.turn) AS f FROM conversations c
    ), ring AS (
        SELECT session, asked.turn, slot, source, score FROM asked JOIN scored USING (session) WHERE slot < f AND slot >= f - 8
    )"""


def touches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(touches, turns) of the conversations."""
    turns = turn_sources(spark, sf_dir)
    each = turns.select("session", "turn", F.posexplode(F.arrays_zip("sources", "hits")).alias("pos", "_s"))
    return each.select("session", "turn", "pos", F.col("_s.sources").alias("source"), F.col("_s.hits").alias("score")), turns.select("session", "turn")


@query(_RING_SQL + " FROM ring")
def ring_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of eight touches before every turn."""
    return R.ring_at(*touches(spark, sf_dir), 8)


@query(_RING_SQL + """, best AS (
        SELECT session, turn, source, max((score, slot)) AS b FROM ring GROUP BY ALL
    ), both_ AS (
        SELECT t.session, t.turn, t.source AS unit, rank, b, CASE WHEN b IS NOT NULL THEN row_number() OVER (PARTITION BY t.session, t.turn ORDER BY b[1] DESC NULLS LAST, b[2] DESC NULLS LAST, rank) END AS c
        FROM touched t LEFT JOIN best USING (session, turn, source)
    ), marked AS (
        SELECT *, coalesce(c <= 3, false) AS "primary" FROM both_
    )
    SELECT session, turn, unit, row_number() OVER (PARTITION BY session, turn ORDER BY "primary" DESC, CASE WHEN "primary" THEN c END, rank) AS place, "primary",
           CASE WHEN bool_and("primary") OVER (PARTITION BY session, turn) THEN 'direct' WHEN bool_or("primary") OVER (PARTITION BY session, turn) THEN 'chunked' END AS strategy
    FROM marked""")
def ring_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every turn with the three first that its ring holds and scores highest."""
    found, turns = touches(spark, sf_dir)
    retrieved = found.select("session", "turn", F.col("pos").alias("rank"), F.col("source").alias("unit"))
    return R.planned_context(R.ring_at(found, turns, 8), retrieved, 3)


@query(_RING_SQL + """, g AS (SELECT session, turn, list(source ORDER BY slot) AS s, list(score ORDER BY slot) AS v FROM ring GROUP BY ALL HAVING count(*) >= 3)
    SELECT session, turn, array_to_string(s, ',') AS sources, array_to_string(v, ',') AS scores, list_position(v, list_max(v)) - 1 AS gold FROM g""")
def ring_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training record per turn whose ring holds three slots or more."""
    t = R.trace_records(R.ring_at(*touches(spark, sf_dir), 8))
    return t.select("session", "turn", F.array_join("sources", ",").alias("sources"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"), F.col("gold").cast("long").alias("gold"))


#: Lists are the events of a user, in order of time, scored by value; purchases are gold.
_LISTS_SQL = "SELECT user_id AS list, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, value / 10 AS score, event_type = 'purchase' AS gold FROM events"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    rows = e.select(F.col("user_id").alias("list"), F.struct("ts", "event_id").alias("at"), (F.col("value") / 10).alias("score"), (F.col("event_type") == "purchase").alias("gold"))
    placed = placed_values(rows, "list", "at").select("list", "at", F.col("before").alias("place"))
    return rows.join(placed, ["list", "at"]).select("list", "place", "score", "gold")


@query(f"""WITH l AS ({_LISTS_SQL}), m AS (SELECT list, max(score) AS top FROM l GROUP BY list), z AS (SELECT list, top + ln(sum(exp(score - top))) AS lse FROM l JOIN m USING (list) GROUP BY list, top)
    SELECT list, round(CASE WHEN count(*) FILTER (gold) > 0 THEN any_value(lse) - avg(score) FILTER (gold) ELSE 0 END, 6) AS loss FROM l JOIN z USING (list) GROUP BY list""")
def listwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far purchases stand below the rest of a user's events."""
    return L.listwise(_lists(spark, sf_dir)).select("list", F.round("loss", 6).alias("loss"))


@query(f"""WITH l AS ({_LISTS_SQL}), t AS (SELECT a.list, a.place, a.score, max(b.score) AS top FROM l a JOIN l b ON a.list = b.list AND b.place >= a.place GROUP BY ALL),
    c AS (SELECT t.list, t.place, any_value(top) + ln(sum(exp(b.score - top))) - any_value(t.score) AS cost FROM t JOIN l b ON t.list = b.list AND b.place >= t.place GROUP BY t.list, t.place)
    SELECT list, count(*) AS n, round(sum(cost), 4) AS loss FROM c GROUP BY list""")
def plackett_luce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely the order of a user's events is under their values."""
    return L.plackett_luce(_lists(spark, sf_dir)).select("list", "n", F.round("loss", 4).alias("loss"))


#: A class is the mean vector of a label; a logit is the dot product with it.
_LOGITS_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    parts AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY ALL), c AS (SELECT label AS class, list(m ORDER BY i) AS m FROM parts GROUP BY label),
    logits AS (SELECT vec_id AS item, class, label, round(list_dot_product(e, m), 6) AS logit FROM v, c)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("_i", "_x"))
    means = v.groupBy("label", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_r")).select(F.col("label").cast("long").alias("class"), F.transform("_r", lambda x: x["_m"]).alias("vector"))


@query("WITH " + _LOGITS_SQL + """, z AS (SELECT item, max(logit) + ln(sum(exp(logit))) - max(logit) AS lse FROM logits GROUP BY item)
    SELECT item, round((CASE WHEN label = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * (lse - logit) + CASE WHEN label = 1 THEN 3.0::DOUBLE * exp((SELECT o.logit FROM logits o WHERE o.item = l.item AND o.class = 2) - lse) ELSE 0 END, 5) AS loss
    FROM logits l JOIN z USING (item) WHERE class = label""")
def unsafe_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cross-entropy of vectors against their label, with a price on taking label 1 for 2."""
    from memlattice.operators.classes import nearest_classes

    v, means = T.table(spark, sf_dir, "embeddings"), _means(spark, sf_dir)
    entities = v.select(F.col("vec_id").alias("entity"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    logits = nearest_classes(entities, means, 1 << 16).select(F.col("entity").alias("item"), "class", F.col("score").alias("logit"))
    truth = v.select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("class"))
    return L.cross_entropy(logits, truth, {0: 2.0}, (1, 2), 3.0).select("item", F.round("loss", 5).alias("loss"))


@query("WITH " + _LOGITS_SQL + """, p AS (SELECT vec_id // 50 AS batch, vec_id, e, m FROM v JOIN c ON c.class = v.label),
    l AS (SELECT a.batch, a.vec_id, a.vec_id = b.vec_id AS own, list_cosine_similarity(a.e, b.m) / 0.1::DOUBLE AS x FROM p a JOIN p b ON a.batch = b.batch),
    i AS (SELECT batch, vec_id, ln(sum(exp(x))) - max(x) FILTER (own) AS loss FROM l GROUP BY ALL)
    SELECT batch::BIGINT AS batch, count(*) AS n, round(avg(loss), 5) AS loss FROM i GROUP BY batch""")
def contrast_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against the means of their labels, in batches of fifty."""
    v = T.table(spark, sf_dir, "embeddings")
    own = v.select((F.col("vec_id") / 50).cast("long").alias("batch"), F.transform("embedding", lambda x: x.cast("double")).alias("anchor"), F.col("label").cast("long").alias("class"))
    pairs = own.join(_means(spark, sf_dir), "class").select("batch", "anchor", F.col("vector").alias("positive"))
    return L.in_batch_contrast(pairs).select("batch", "n", F.round("loss", 5).alias("loss"))
