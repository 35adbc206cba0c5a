"""Queries of labelling and gates: recombined shards, groups, taxonomies, overlays, sweeps, schedules, routes, heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators import dream as D
from memlattice.operators import shards as S
from memlattice.operators import taxonomy as O
from memlattice.operators import trials as V
from memlattice.plans import upkeep
from memlattice.registry import query
from memlattice.sources import tables as T

#: Every exchange of a user is a shard: it scores what it names by place, and itself by how much that is.
_SHARDS_SQL = T.EDGES_SQL + """, records AS (
        SELECT "user" AS center, conv_id * 1000 + turn AS shard, id, list_sort(entities) AS entities, length(reply) // 4 AS cost FROM episodes
    ), scores AS (
        SELECT center, shard, 'E:' || unnest(entities) AS node, 1.0::DOUBLE / generate_subscripts(entities, 1) AS score FROM records
        UNION ALL SELECT center, shard, id, least(1.0::DOUBLE, len(entities) / 20.0::DOUBLE) FROM records
    ), nodes AS (
        SELECT center, node, arg_min(score, shard) AS score FROM scores GROUP BY ALL
    )"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = (F.col("conv_id") * 1000 + F.col("turn")).alias("shard")
    return T.episodes(spark, sf_dir).select(F.col("user").alias("center"), shard, "id", F.array_sort("entities").alias("entities"), X.token_estimate(F.col("reply")).alias("cost"))


def _scores(records: DataFrame) -> DataFrame:
    named = records.select("center", "shard", F.posexplode("entities").alias("_i", "_e")).select("center", "shard", F.concat(F.lit("E:"), "_e").alias("node"), (1.0 / (F.col("_i") + 1)).alias("score"))
    return named.unionByName(records.select("center", "shard", F.col("id").alias("node"), F.least(F.lit(1.0), F.size("entities") / 20.0).alias("score")))


@query("WITH " + _SHARDS_SQL + ", sums AS (SELECT center, count(*) AS n_records, sum(cost)::BIGINT AS cost FROM records GROUP BY center) SELECT center, node, round(score, 6) AS score, n_records, cost FROM nodes JOIN sums USING (center)")
def recombined_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node scores of every user's shards put together, with the subgraph's number of records and cost."""
    records = _records(spark, sf_dir)
    nodes = S.node_scores(_scores(records)).join(S.shard_costs(records), "center")
    return nodes.select("center", "node", F.round("score", 6).alias("score"), "n_records", "cost")


@query("WITH " + _SHARDS_SQL + " SELECT r.center, s, p, o, round((x.score + y.score) / 2, 6) AS score FROM edges JOIN records r ON r.id = s JOIN nodes x ON x.center = r.center AND x.node = s JOIN nodes y ON y.center = r.center AND y.node = o")
def recombined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of edges between nodes that both have one."""
    records = _records(spark, sf_dir)
    own = T.edges(spark, sf_dir).join(records.select("center", F.col("id").alias("s")), "s")
    return S.edge_scores(S.node_scores(_scores(records)), own).withColumn("score", F.round("score", 6))


@query("WITH " + _SHARDS_SQL + ", items AS (SELECT center, shard, unnest(entities) AS item, generate_subscripts(entities, 1) AS i FROM records) SELECT center, row_number() OVER (PARTITION BY center ORDER BY shard, i) - 1 AS place, item FROM items")
def recombined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of every user's shards one after another."""
    return S.joined_lists(_records(spark, sf_dir).withColumnRenamed("entities", "items"))


_TONES = ("expansive", "terse", "tabular")
_CLUSTERS_SQL = T.EPISODES_SQL + """, toned AS (
        SELECT "user" AS center, id, entities, list_transform(['expansive', 'terse', 'tabular'], lambda x: CASE WHEN list_contains(tones, x) THEN 1.0::DOUBLE / len(tones) ELSE 0.0::DOUBLE END) AS w FROM episodes WHERE len(tones) > 0
    ), each AS (
        SELECT center, id AS node, w FROM toned UNION ALL SELECT center, 'E:' || unnest(entities), w FROM toned
    ), weights AS (
        SELECT center, node, [round(avg(w[1]), 9), round(avg(w[2]), 9), round(avg(w[3]), 9)] AS w FROM each GROUP BY ALL
    ), assigned AS (
        SELECT center, node, list_position(w, list_max(w)) - 1 AS cluster, list_max(w) AS weight FROM weights
    )"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and entities of every user with the shares of their tones."""
    share = F.transform(F.array(*map(F.lit, _TONES)), lambda x: F.when(F.array_contains("tones", x), 1.0 / F.size("tones")).otherwise(0.0))
    toned = T.episodes(spark, sf_dir).where(F.size("tones") > 0).select(F.col("user").alias("center"), "id", "entities", share.alias("_w"))
    each = toned.select("center", F.col("id").alias("node"), "_w").unionByName(toned.select("center", F.explode("entities").alias("_e"), "_w").select("center", F.concat(F.lit("E:"), "_e").alias("node"), "_w"))
    return each.groupBy("center", "node").agg(F.array(*[F.round(F.avg(F.get("_w", F.lit(i))), 9) for i in range(len(_TONES))]).alias("weights"))


@query("WITH " + _CLUSTERS_SQL + " SELECT center, cluster, count(*) FILTER (starts_with(node, 'ep_')) AS n_episodes, round(avg(weight), 5) AS coherence FROM assigned GROUP BY ALL HAVING count(*) FILTER (starts_with(node, 'ep_')) >= 2")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a user's subgraph with two episodes or more, by their heaviest tone, and their coherence."""
    return S.cluster_groups(_weights(spark, sf_dir))[0].withColumn("coherence", F.round("coherence", 5))


@query("WITH " + _CLUSTERS_SQL + ", e AS (SELECT center, cluster, node, count(*) OVER (PARTITION BY center, cluster) AS n FROM assigned WHERE starts_with(node, 'ep_')) SELECT center, cluster, node FROM e WHERE n >= 2")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes of those clusters."""
    return S.cluster_groups(_weights(spark, sf_dir))[1]


@query("WITH " + T.EPISODES_SQL + """, n AS (SELECT DISTINCT session, unnest(list_concat(list_transform(entities, lambda e: 'E:' || e), list_transform(topics, lambda t: 'T:' || t))) AS node FROM episodes),
    p AS (SELECT a.session, a.node AS a, b.node AS b, row_number() OVER (PARTITION BY a.session ORDER BY a.node, b.node) AS k FROM n a JOIN n b ON a.session = b.session AND a.node < b.node) SELECT session, a, b FROM p WHERE k <= 64""")
def ontology_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair candidates among the entities and topics of each session: the first 64 in sorted order, the feature's budget."""
    prefixed = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    nodes = T.episodes(spark, sf_dir).select(F.col("session").alias("center"), F.explode(F.concat(prefixed("entities", "E:"), prefixed("topics", "T:"))).alias("node"))
    return S.pair_candidates(nodes, 64).withColumnRenamed("center", "session")


#: Hosts of pages are classes, under their domain and under the first folders of their pages.
_HOSTS_SQL = """hosts AS (
        SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+/([^/?#]+)', 1) AS folder FROM pages
    ), domains AS (
        SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', '') AS class, host AS subclass FROM hosts WHERE contains(host, '.')
    ), folders AS (
        SELECT DISTINCT '/' || folder AS class, host AS subclass FROM hosts WHERE folder <> ''
    )"""


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return T.table(spark, sf_dir, "pages").select("page_id", F.lower(part("://([^/?#]+)")).alias("host"), part("://[^/?#]+/([^/?#]+)").alias("folder"))


def _domains(hosts: DataFrame) -> DataFrame:
    return hosts.where(F.contains("host", F.lit("."))).select(F.regexp_replace("host", r"^[^.]*\.", "").alias("class"), F.col("host").alias("subclass"))


@query("WITH " + _HOSTS_SQL + ", u AS (SELECT * FROM domains UNION SELECT * FROM folders) SELECT class, count(subclass) AS n_subclasses FROM (SELECT * FROM u UNION ALL SELECT subclass, NULL FROM u) GROUP BY class")
def merged_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a taxonomy as one: hosts under domains, hosts under folders."""
    hosts = _hosts(spark, sf_dir)
    folders = hosts.where("folder <> ''").select(F.concat(F.lit("/"), "folder").alias("class"), F.col("host").alias("subclass"))
    return O.merged_classes(_domains(hosts), folders).groupBy("class").agg(F.count("subclass").alias("n_subclasses"))


@query("WITH " + _HOSTS_SQL + ", n AS (SELECT host, count(*) AS n FROM hosts GROUP BY host) SELECT page_id::VARCHAR AS page, coalesce(class, host) AS class, class IS NOT NULL AS moved FROM hosts JOIN n USING (host) LEFT JOIN domains ON subclass = host AND n = 1 WHERE host <> ''")
def reassigned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host has no other page go to the domain above it."""
    hosts = _hosts(spark, sf_dir).where("host <> ''")
    typed = hosts.select(F.col("page_id").cast("string").alias("s"), F.lit("instanceOf").alias("p"), F.col("host").alias("o"))
    above = _domains(hosts).select(F.col("subclass").alias("s"), F.lit("subClassOf").alias("p"), F.col("class").alias("o"))
    rare = hosts.groupBy(F.col("host").alias("class")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("class")
    return O.reassigned(typed.unionByName(above), rare).where("p = 'instanceOf'").select(F.col("s").alias("page"), F.col("o").alias("class"), "moved")


@query("WITH k AS (SELECT event_type || '/' || user_id AS key, arg_min(value, event_id) AS base, arg_max(value, event_id) AS over FROM events GROUP BY 1) SELECT key, CASE WHEN starts_with(key, 'purchase/') OR starts_with(key, 'error/') THEN over ELSE base END AS value, starts_with(key, 'purchase/') OR starts_with(key, 'error/') AS overlaid FROM k")
def overlaid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each user and event type, with the last one laid over it for two types."""
    keyed = T.table(spark, sf_dir, "events").groupBy(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"))
    return O.overlaid(keyed.agg(F.min_by("value", "event_id").alias("value")), keyed.agg(F.max_by("value", "event_id").alias("value")), ["purchase/", "error/"])


_GRID = [k / 10 for k in range(1, 10)]
_SHIPPED = {"theta": 0.9, "phi": 0.1, "cap": 0.6}


@query("WITH " + T.EPISODES_SQL + """, x AS (
        SELECT list_distinct(regexp_extract_all(lower(prompt), '[0-9a-z]+')) AS a, list_distinct(regexp_extract_all(lower(reply), '[0-9a-z]+')) AS b,
               list_distinct(regexp_extract_all(prompt, '[A-Z][a-z]{5,}')) AS wanted, list_distinct(regexp_extract_all(reply, '[A-Z][a-z]{5,}')) AS got, length(reply) / 3000.0::DOUBLE AS s FROM episodes
    ), y AS (
        SELECT CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END AS r, CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, got)) / len(wanted) END AS c, least(1.0::DOUBLE, s) AS s FROM x
    ), t AS (
        SELECT r, c, s, coalesce(c = 1, false) AS covered FROM y
    ), v AS (
        SELECT axis, k / 10.0::DOUBLE AS value, CASE WHEN axis = 'theta' THEN k / 10.0::DOUBLE ELSE 0.9::DOUBLE END AS theta, CASE WHEN axis = 'phi' THEN k / 10.0::DOUBLE ELSE 0.1::DOUBLE END AS phi, CASE WHEN axis = 'cap' THEN k / 10.0::DOUBLE ELSE 0.6::DOUBLE END AS cap
        FROM (SELECT unnest(['theta', 'phi', 'cap']) AS axis), (SELECT unnest(range(1, 10)) AS k)
    ), f AS (
        SELECT axis, value, covered, coalesce(c < theta AND r > phi AND s < cap, false) AS fires FROM t, v
    ) SELECT axis, value, count(*) FILTER (fires) AS firing, count(*) FILTER (fires OR covered) AS coverage_on, count(*) FILTER (covered) AS coverage_off, count(*) FILTER (fires AND NOT covered) AS rescued, count(*) FILTER (fires OR covered) - count(*) FILTER (covered) AS delta FROM f GROUP BY ALL""")
def trial_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exchange is a trial: likeness of prompt and reply, share of the prompt's names in the reply, the reply's length; three thresholds swept."""
    e = T.episodes(spark, sf_dir)
    wanted, got = X.capitalised(F.col("prompt"), 6), X.capitalised(F.col("reply"), 6)
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, got)) / F.size(wanted))
    trials = e.select(X.jaccard(X.word_tokens(F.col("prompt")), X.word_tokens(F.col("reply"))).alias("relevance"), share.alias("recoverability"), F.least(F.lit(1.0), F.length("reply") / 3000.0).alias("surprise"))
    return V.threshold_sweep(trials.withColumn("covered", F.col("recoverability") == 1), dict.fromkeys(_SHIPPED, _GRID), _SHIPPED)


_FACTS_SQL = """scores AS (
        SELECT user_id::VARCHAR AS fact, event_id AS turn, event_type, value / 500 AS relevance FROM events
    ), facts AS (
        SELECT fact, arg_max(relevance, turn) FILTER (event_type = 'purchase') AS probe, avg(relevance) FILTER (event_type IN ('view', 'click')) AS filler, count(*) FILTER (event_type IN ('view', 'click')) AS n_filler FROM scores GROUP BY fact
    )"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a fact: purchases ask for it, views and clicks for none."""
    fact = F.col("user_id").cast("string")
    target = F.when(F.col("event_type") == "purchase", fact).when(~F.col("event_type").isin("view", "click"), "other")
    return V.selectivity(T.table(spark, sf_dir, "events").select(F.col("event_id").alias("turn"), fact.alias("fact"), target.alias("target"), (F.col("value") / 500).alias("relevance")))


@query("WITH " + _FACTS_SQL + " SELECT fact, round(probe, 6) AS probe, round(filler, 6) AS filler, n_filler, round(probe - filler, 6) AS gap FROM facts")
def fact_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's last probe against the mean of its fillers."""
    return _facts(spark, sf_dir).select("fact", *[F.round(c, 6).alias(c) for c in ("probe", "filler")], "n_filler", F.round("gap", 6).alias("gap"))


@query("WITH " + _FACTS_SQL + " SELECT coalesce(min(probe - filler) >= 0.2, false) AS discriminates, round(min(probe - filler), 6) AS min_gap, count(probe - filler) AS n FROM facts")
def selectivity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all facts stand out from their fillers."""
    return V.discriminates(_facts(spark, sf_dir)).withColumn("min_gap", F.round("min_gap", 6))


_FILLERS = ["And then?", "Tell me more.", "What else is there?", "What is new?", "Why is that?"]


@query("WITH " + T.EPISODES_SQL + """, facts AS (SELECT DISTINCT session AS center, unnest(entities) AS fact FROM episodes),
    placed AS (SELECT center, fact, row_number() OVER (PARTITION BY center ORDER BY sha256('7|' || fact)) - 1 AS i, count(*) OVER (PARTITION BY center) AS n FROM facts),
    probes AS (SELECT center, least(10 + i * CASE WHEN n > 1 THEN greatest(4, 28 // greatest(1, n - 1)) ELSE 1 END, 39) AS turn, arg_max(fact, i) AS fact FROM placed GROUP BY 1, 2),
    fillers AS (SELECT filler, row_number() OVER (ORDER BY sha256('7|' || filler)) - 1 AS k FROM (SELECT unnest(['And then?', 'Tell me more.', 'What else is there?', 'What is new?', 'Why is that?']) AS filler)),
    slots AS (SELECT center, unnest(range(0, 40)) AS turn FROM (SELECT DISTINCT center FROM facts))
    SELECT center, turn, fact, CASE WHEN fact IS NULL THEN filler END AS filler FROM slots LEFT JOIN probes USING (center, turn) JOIN fillers ON k = turn % 5""")
def probe_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty turns for every session: its entities are probed in a seeded order, fillers between."""
    facts = T.episodes(spark, sf_dir).select(F.col("session").alias("center"), F.explode("entities").alias("fact"))
    return V.probe_schedule(facts, _FILLERS, 40, 7)


_ROUTE_SQL = """CASE WHEN len(regexp_extract_all({0}, '[A-Z][a-z]{{5,}}')) > 0 THEN 'recall' ELSE 'direct' END AS pathway_{0}, list_distinct(list_transform(regexp_extract_all(lower({0}), '[a-z]{{10,}}'), lambda w: substr(w, 1, 1))) AS domains_{0},
    CASE WHEN length({0}) > 400 THEN 'large' ELSE 'small' END AS size_{0}, contains({0}, '?') OR contains({0}, '|') AS deliberates_{0}"""


def _route(text: Column) -> Column:
    """What a rule over one text would choose."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{10,})"), F.lit(1))
    return F.struct(
        F.when(F.size(X.capitalised(text, 6)) > 0, "recall").otherwise("direct").alias("pathway"), F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 1))).alias("domains"),
        F.when(F.length(text) > 400, "large").otherwise("small").alias("size"), (text.contains("?") | text.contains("|")).alias("deliberates"),
    )


@query("WITH " + T.EPISODES_SQL + ", r AS (SELECT " + _ROUTE_SQL.format("reply") + ", " + _ROUTE_SQL.format("prompt") + """ FROM episodes), x AS (SELECT *, list_intersect(domains_reply, ['a', 'd', 'e', 'm', 'p', 't']) AS want FROM r), f AS (
        SELECT *, CASE WHEN len(want) = 0 AND len(domains_prompt) = 0 THEN 1.0::DOUBLE WHEN len(want) = 0 OR len(domains_prompt) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(want, domains_prompt)) / (len(want) + len(domains_prompt)) END AS f1 FROM x
    ), p AS (SELECT avg((pathway_reply = pathway_prompt)::INT) AS pathway, avg(f1) AS domain, avg((size_reply = size_prompt)::INT) AS size, avg((deliberates_reply = deliberates_prompt)::INT) AS deliberation, count(*) AS n FROM f)
    SELECT round(0.35::DOUBLE * pathway + 0.30::DOUBLE * domain + 0.20::DOUBLE * size + 0.15::DOUBLE * deliberation, 6) AS accuracy, round(domain, 6) AS domain, n FROM p""")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the route chosen from a prompt fits the one its reply would have called for, over six available domains."""
    routes = T.episodes(spark, sf_dir).select(_route(F.col("reply")).alias("want"), _route(F.col("prompt")).alias("got"))
    return V.routing_accuracy(routes, F.array(*map(F.lit, "adempt"))).select(F.round("accuracy", 6).alias("accuracy"), F.round("domain", 6).alias("domain"), "n")


@query("""WITH s AS (SELECT unnest(['quality', 'toxic']) AS head, unnest([quality, toxic]) AS label, least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT * FROM s WHERE label IS NOT NULL AND score IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY head ORDER BY score) + (count(*) OVER (PARTITION BY head, score) - 1) / 2.0::DOUBLE AS place FROM k),
    g AS (SELECT head, count(*) AS n, avg(abs(score - label)) AS mae, avg((round_even(score, 0) = label)::INT) AS accuracy, sum(label) AS p, sum(place) FILTER (label = 1) AS ranks FROM r GROUP BY head)
    SELECT head, n, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy, round(CASE WHEN p > 0 AND p < n THEN (ranks - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) ELSE accuracy END, 6) AS quality FROM g""")
def head_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as a score for two labels: mean error, accuracy and area under the curve."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("score"), F.col("n_chars").alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("head"), F.col(c).cast("double").alias("label")) for c in ("quality", "toxic")])).alias("_h")
    rows = T.table(spark, sf_dir, "labels").join(docs, "doc_id").where("_n IS NOT NULL").select("score", each).select("_h.head", "score", "_h.label")
    return V.head_metrics(rows).select("head", "n", *[F.round(c, 6).alias(c) for c in ("mae", "accuracy", "quality")])


@query("WITH " + upkeep._MEMORY_SQL + " SELECT p, action, count(*) AS n, round(avg(strength), 5) AS strength FROM decided GROUP BY ALL")
def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a consolidation pass: what its fixed order of detectors decided, by predicate."""
    decided, _ = D.consolidate(*upkeep.memory(spark, sf_dir), upkeep.RULES, F.lit(upkeep.NOW).cast("timestamp"))
    return decided.groupBy("p", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strength"), 5).alias("strength"))
