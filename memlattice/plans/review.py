"""Review and evaluation: injected anomalies, recalls, salience decisions, signals, references, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.registry import query
from memlattice.sources import tables as T


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events")


@query("WITH " + T.EPISODES_SQL + ", t AS (SELECT id, unnest(tones) AS tone FROM episodes) SELECT id, string_agg(DISTINCT CASE tone WHEN 'expansive' THEN '0' WHEN 'terse' THEN '1' ELSE '2' END, ',' ORDER BY CASE tone WHEN 'expansive' THEN '0' WHEN 'terse' THEN '1' ELSE '2' END) AS labels FROM t GROUP BY id")
def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted label numbers of each unit with any."""
    t = T.episodes(spark, sf_dir).select("id", F.explode("tones").alias("tone"))
    number = F.when(F.col("tone") == "expansive", "0").when(F.col("tone") == "terse", "1").otherwise("2")
    return t.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(number)), ",").alias("labels"))


@query("WITH " + T.EPISODES_SQL + " SELECT DISTINCT class FROM (SELECT unnest(topics) AS class FROM episodes UNION ALL SELECT unnest(tones) FROM episodes)")
def class_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct classes of two nested arrays."""
    e = T.episodes(spark, sf_dir)
    return e.select(F.explode(F.concat("topics", "tones")).alias("class")).distinct()


@query("WITH " + T.EPISODES_SQL + ", x AS (SELECT id, list_distinct(regexp_extract_all(prompt, '[A-Z][a-z]{5,}')) AS wanted, list_distinct(regexp_extract_all(reply, '[A-Z][a-z]{5,}')) AS got FROM episodes) SELECT id, len(wanted) AS n_wanted, CASE WHEN len(wanted) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(wanted, got)) / len(wanted), 6) END AS recall FROM x")
def set_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a prompt's names that the reply has too; 1 where the prompt has none."""
    x = T.episodes(spark, sf_dir).select("id", X.capitalised(F.col("prompt"), 6).alias("w"), X.capitalised(F.col("reply"), 6).alias("g"))
    share = F.round(F.size(F.array_intersect("w", "g")) / F.size("w"), 6)
    return x.select("id", F.size("w").cast("long").alias("n_wanted"), F.when(F.size("w") == 0, 1.0).otherwise(share).alias("recall"))


@query("WITH " + T.EPISODES_SQL + ", k AS (SELECT id, lower(body) AS body, list_transform(tones, lambda t: substr(t, 1, 4)) AS words FROM episodes) SELECT id, CASE WHEN len(words) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(words, lambda w: contains(body, w))) / len(words), 6) END AS recall FROM k")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of expected keywords that occur in the text; 1 where none is expected."""
    e = T.episodes(spark, sf_dir).select("id", F.lower(F.concat_ws(" ", "prompt", "reply")).alias("b"), F.transform("tones", lambda t: F.substring(t, 1, 4)).alias("w"))
    hits = F.size(F.filter("w", lambda w: F.contains(F.col("b"), w)))
    return e.select("id", F.when(F.size("w") == 0, 1.0).otherwise(F.round(hits / F.size("w"), 6)).alias("recall"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT event_id, turn - min(turn) OVER (PARTITION BY user_id, event_type) AS age FROM t")
def source_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns since a source was first seen."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = _events(spark, sf_dir).withColumn("turn", turn)
    first = F.min("turn").over(Window.partitionBy("user_id", "event_type"))
    return t.select("event_id", (F.col("turn") - first).cast("long").alias("age"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events), g AS (SELECT event_id, turn - lag(turn) OVER (PARTITION BY user_id, event_type ORDER BY turn) AS gap FROM t) SELECT event_id, gap, CASE WHEN gap IS NULL THEN 'new' WHEN gap < 3 THEN 'recall' ELSE 'lagged' END AS signal FROM g")
def reappearance_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source comes back within the lag of three turns."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = _events(spark, sf_dir).withColumn("turn", turn)
    gap = F.col("turn") - F.lag("turn").over(Window.partitionBy("user_id", "event_type").orderBy("turn"))
    signal = F.when(gap.isNull(), "new").when(gap < 3, "recall").otherwise("lagged")
    return t.select("event_id", gap.cast("long").alias("gap"), signal.alias("signal"))


@query("WITH " + T.EPISODES_SQL + ", a AS (SELECT session, id, ts, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS n FROM episodes WHERE len(entities) >= 2) SELECT session, id, n AS place FROM a WHERE n <= 3")
def salient_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor budget: the first three units of a session that name two entities or more, oldest first."""
    a = T.episodes(spark, sf_dir).where(F.size("entities") >= 2)
    n = F.row_number().over(Window.partitionBy("session").orderBy("ts", "id"))
    return a.select("session", "id", n.cast("long").alias("place")).where("place <= 3")


@query("WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 200 END AS rec, (user_id % 10) / 10 AS rel, (event_id % 7) / 7 AS sur FROM events), d AS (SELECT *, coalesce(rec < 0.3 AND rel > 0.4 AND sur < 0.8, false) AS salient FROM s) SELECT event_id, salient, CASE WHEN salient THEN 'gap: relevance ' || CASE WHEN rel > 0.7 THEN 'high' ELSE 'mid' END || ', surprise ' || CASE WHEN sur > 0.4 THEN 'high' ELSE 'low' END END AS statement FROM d")
def salience_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salient where recoverability is low, relevance high and surprise under its cap; an unknown is no."""
    s = _events(spark, sf_dir).select("event_id", F.when(F.col("event_type") != "error", F.col("value") / 200).alias("rec"), (F.col("user_id") % 10 / 10).alias("rel"), (F.col("event_id") % 7 / 7).alias("sur"))
    salient = F.coalesce((F.col("rec") < 0.3) & (F.col("rel") > 0.4) & (F.col("sur") < 0.8), F.lit(False))
    parts = F.array(F.concat(F.lit("gap: relevance "), F.when(F.col("rel") > 0.7, "high").otherwise("mid")), F.concat(F.lit("surprise "), F.when(F.col("sur") > 0.4, "high").otherwise("low")))
    return s.select("event_id", salient.alias("salient"), F.when(salient, F.array_join(parts, ", ")).alias("statement"))


#: Salience and decay of each signal.
PROFILES = {"purchase": (1.0, 0.01), "signup": (0.8, 0.02), "click": (0.4, 0.05), "view": (0.2, 0.1)}
_SIGNALS = sorted(PROFILES)


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{s}' THEN '{','.join(str(int(x == s)) for x in _SIGNALS)}'" for s in _SIGNALS) + " ELSE '0,0,0,0' END AS one_hot, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in PROFILES.items()) + " ELSE 0.5::DOUBLE END AS salience, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in PROFILES.items()) + " ELSE 0.05::DOUBLE END AS decay FROM events")
def signal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as a one-hot vector, with salience and decay from a fixed map and its default."""
    hot = F.array_join(F.transform(F.array(*map(F.lit, _SIGNALS)), lambda s: F.when(s == F.col("event_type"), "1").otherwise("0")), ",")
    lookup = lambda at: F.create_map(*[F.lit(x) for k, v in PROFILES.items() for x in (k, v[at])])[F.col("event_type")]
    return _events(spark, sf_dir).select("event_id", hot.alias("one_hot"), F.coalesce(lookup(0), F.lit(0.5)).alias("salience"), F.coalesce(lookup(1), F.lit(0.05)).alias("decay"))


_ODD = "substr(md5({0} || ':injected'), 1, 1) IN ('0', '1')"
_INJECTED_SQL = T.EDGES_SQL + f""", follows AS (SELECT s, o FROM edges WHERE p = 'follows'), topics AS (SELECT s, o FROM edges WHERE p = 'has_topic'),
    broken AS (SELECT s, CASE WHEN {_ODD.format("s")} THEN 'ep_missing_' || s ELSE o END AS o FROM follows),
    kept AS (SELECT s, o FROM topics WHERE NOT {_ODD.format("s || 't'")}),
    states AS (SELECT id AS s, 'open' AS o FROM episodes UNION ALL SELECT id, 'closed' FROM episodes WHERE {_ODD.format("id || 's'")}),
    planted AS (SELECT 'broken_follows' AS kind, s FROM follows WHERE {_ODD.format("s")} UNION ALL SELECT DISTINCT 'no_topic', s FROM topics WHERE {_ODD.format("s || 't'")} UNION ALL SELECT 'two_states', id FROM episodes WHERE {_ODD.format("id || 's'")}),
    found AS (SELECT 'broken_follows' AS kind, s FROM broken WHERE o NOT IN (SELECT id FROM episodes) UNION ALL SELECT 'no_topic', id FROM episodes WHERE id NOT IN (SELECT s FROM kept) UNION ALL SELECT 'two_states', s FROM states GROUP BY s HAVING count(DISTINCT o) > 1)"""


@query("WITH " + _INJECTED_SQL + " SELECT p.kind, count(*) AS planted, count(f.s) AS detected, round(count(f.s) / count(*), 6) AS recall FROM planted p LEFT JOIN found f ON f.kind = p.kind AND f.s = p.s GROUP BY p.kind")
def injected_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corruptions injected by a hash of the id (a broken follows edge, a unit without topics, a second state) against what the detectors find."""
    odd = lambda tag: F.substring(F.md5(F.concat(F.col("s"), F.lit(f"{tag}:injected"))), 1, 1).isin("0", "1")
    edges, ids = T.edges(spark, sf_dir), T.episodes(spark, sf_dir).select(F.col("id").alias("s"))
    follows, topics = edges.where("p = 'follows'").select("s", "o"), edges.where("p = 'has_topic'").select("s", "o")
    broken = follows.withColumn("o", F.when(odd(""), F.concat(F.lit("ep_missing_"), "s")).otherwise(F.col("o")))
    states = ids.withColumn("o", F.lit("open")).union(ids.where(odd("s")).withColumn("o", F.lit("closed")))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "s")
    planted = named("broken_follows", follows.where(odd(""))).union(named("no_topic", topics.where(odd("t")).select("s").distinct())).union(named("two_states", ids.where(odd("s"))))
    found = (
        named("broken_follows", broken.join(ids.withColumnRenamed("s", "o"), "o", "left_anti"))
        .union(named("no_topic", ids.join(topics.where(~odd("t")), "s", "left_anti")))
        .union(named("two_states", states.groupBy("s").agg(F.countDistinct("o").alias("_n")).where("_n > 1")))
        .withColumn("_hit", F.lit(1))
    )
    both = planted.join(found, ["kind", "s"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("planted"), F.count("_hit").alias("detected"))
    return both.withColumn("recall", F.round(F.col("detected") / F.col("planted"), 6))


@query("WITH " + T.EPISODES_SQL + ", e AS (SELECT DISTINCT unnest(entities) AS name FROM episodes) SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM e")
def entity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as lower-case slugs."""
    e = T.episodes(spark, sf_dir).select(F.explode("entities").alias("name")).distinct()
    return e.select("name", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


@query("SELECT conv_id, turn, 'in_reply_to' AS p, turn - 1 AS target FROM conversations WHERE turn >= 1 UNION ALL SELECT c.conv_id, c.turn, 'references', t FROM conversations c, LATERAL (SELECT unnest(range(greatest(c.turn - 3, 0), c.turn)) AS t)")
def thread_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply and reference edges inside a thread, from each message's list of the three before it."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    listed = c.where("turn >= 1").withColumn("refs", F.array_join(F.sequence(F.greatest(F.col("turn") - 3, F.lit(0)), F.col("turn") - 1), " "))
    refs = listed.select("conv_id", "turn", F.lit("references").alias("p"), F.explode(F.transform(F.split("refs", " "), lambda r: r.cast("long"))).alias("target"))
    return listed.select("conv_id", "turn", F.lit("in_reply_to").alias("p"), (F.col("turn") - 1).alias("target")).union(refs)


@query("WITH m AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), k AS (SELECT source, lang AS kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM m) WHERE r = 1) SELECT d.doc_id, k.kind, d.lang = k.kind AS agrees FROM documents d LEFT JOIN k ON k.source = d.source")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's most frequent kind."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    m = d.where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    k = m.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("kind"))
    return d.join(k, "source", "left").select("doc_id", "kind", (F.col("lang") == F.col("kind")).alias("agrees"))


@query("WITH " + T.EPISODES_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS r FROM episodes) SELECT session, string_agg(substr(summary, 1, 512), chr(10) ORDER BY ts, id) AS gist, count(*) AS n FROM n WHERE r <= 5 GROUP BY session")
def gist_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a session's gist is made of: its first five units (the feature's limit)."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("ts", "id"))
    some = T.episodes(spark, sf_dir).withColumn("_n", n).where("_n <= 5")
    g = some.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "id", F.substring("summary", 1, 512).alias("t")))).alias("_s"))
    return g.select("session", F.array_join(F.transform("_s", lambda r: r["t"]), "\n").alias("gist"), F.size("_s").cast("long").alias("n"))


@query("WITH " + T.EPISODES_SQL + " SELECT id, CASE turn % 3 WHEN 0 THEN 'What was said about ' || e || '?' WHEN 1 THEN 'When did ' || e || ' come up?' ELSE 'Who mentioned ' || e || '?' END AS question FROM (SELECT id, turn, unnest(entities) AS e FROM episodes)")
def episode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question from a template for every entity of every unit."""
    e = T.episodes(spark, sf_dir).select("id", "turn", F.explode("entities").alias("e"))
    say = lambda a, b: F.concat(F.lit(a), "e", F.lit(b))
    text = F.when(F.col("turn") % 3 == 0, say("What was said about ", "?")).when(F.col("turn") % 3 == 1, say("When did ", " come up?")).otherwise(say("Who mentioned ", "?"))
    return e.select("id", text.alias("question"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING bool_and(text IS NOT NULL AND NOT contains(text, '|'))")
def clean_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions none of whose messages is marked."""
    marked = F.col("text").isNull() | F.contains("text", F.lit("|"))
    g = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(marked).alias("_bad"))
    return g.where("NOT _bad").select("conv_id", "n")


@query("WITH " + T.EPISODES_SQL + ' SELECT session, any_value("user") AS "user", min(ts) AS opened_at, max(ts) AS closed_at, count(*) AS n FROM episodes GROUP BY session')
def sessions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with when they opened and closed."""
    return T.episodes(spark, sf_dir).groupBy("session").agg(F.first("user").alias("user"), F.min("ts").alias("opened_at"), F.max("ts").alias("closed_at"), F.count(F.lit(1)).alias("n"))


@query("WITH " + T.SECTIONS_SQL + ", n AS (SELECT doc, count(*) AS k FROM sections GROUP BY doc) SELECT lang AS kind, count(*) AS n_docs, sum(coalesce(k, 0))::BIGINT AS n_sections FROM documents LEFT JOIN n ON n.doc = printf('doc_%06d', doc_id) WHERE lang IS NOT NULL GROUP BY lang")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sections of the export, by kind."""
    k = T.sections(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("k"))
    d = T.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.format_string("doc_%06d", "doc_id").alias("doc"), F.col("lang").alias("kind"))
    return d.join(k, "doc", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("k", F.lit(0))).alias("n_sections"))
