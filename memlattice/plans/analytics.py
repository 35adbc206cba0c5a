"""Evaluation and analytic queries over events, labels, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import scoring as S
from memlattice.operators import evaluation as E
from memlattice.operators import vectors as V
from memlattice.registry import query
from memlattice.sources import tables as T


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


_LABELLED = "WITH l AS (SELECT labels.*, lang, n_chars FROM labels JOIN documents USING (doc_id))"


@query(_LABELLED + """, t AS (SELECT lang, n_chars, sum(quality) AS p, count(*) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rk FROM t),
    g AS (SELECT lang, sum(rk * p) AS s, sum(p) AS pos, sum(n) - sum(p) AS neg FROM r GROUP BY lang)
    SELECT lang, round((s - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg), 6) AS auc, pos::BIGINT AS positives, neg::BIGINT AS negatives FROM g WHERE pos * neg > 0""")
def length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC of text length for quality, by language."""
    a = E.auc(_labelled(spark, sf_dir), "lang", "n_chars", "quality")
    return a.where("auc IS NOT NULL").select("lang", F.round("auc", 6).alias("auc"), "positives", "negatives")


@query(_LABELLED + " SELECT quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess, count(*) AS n FROM l GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against a length rule."""
    rows = _labelled(spark, sf_dir).select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"))
    return E.confusion(rows, "truth", "guess")


@query(_LABELLED + """, r AS (SELECT lang AS truth, count(*) AS n, avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM l GROUP BY lang)
    SELECT truth, n, round(p, 6) AS recall, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)), 6) AS low,
    round(least(1, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)), 6) AS high FROM r""")
def quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents per language with Wilson bounds."""
    rows = _labelled(spark, sf_dir).select(F.col("lang").alias("truth"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("-").alias("guess"))
    r = E.class_recall(rows, "truth", "guess")
    return r.select("truth", "n", *[F.round(c, 6).alias(c) for c in ("recall", "low", "high")])


@query(_LABELLED + """, x AS (SELECT lang AS t, CASE WHEN toxic = 1 THEN 'en' ELSE lang END AS g FROM l), t AS (SELECT t AS c, count(*) AS t, count(*) FILTER (t = g) AS tp FROM x GROUP BY x.t), g AS (SELECT g AS c, count(*) AS g FROM x GROUP BY x.g)
    SELECT count(*) AS classes, round(avg(2.0::DOUBLE * tp / (t.t + coalesce(g.g, 0))), 6) AS macro_f1 FROM t LEFT JOIN g USING (c)""")
def language_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of a guess that takes toxic texts for English."""
    rows = _labelled(spark, sf_dir).select(F.col("lang").alias("t"), F.when(F.col("toxic") == 1, "en").otherwise(F.col("lang")).alias("g"))
    return E.macro_f1(rows, "t", "g").select("classes", F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg(CASE WHEN value >= 99 THEN 1.0::DOUBLE ELSE 0 END), 6) AS tail FROM events GROUP BY event_type")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, mean, deviation and tail share per event type."""
    e = T.table(spark, sf_dir, "events")
    q = E.quantiles(e, "event_type", "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    moments = e.groupBy(F.col("event_type").alias("_type")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"),
        F.round(F.avg(F.when(F.col("value") >= 99, 1.0).otherwise(0.0)), 6).alias("tail"),
    )
    both = moments.join(q, F.col("_type").eqNullSafe(F.col("event_type")), "left")
    return both.select(F.col("_type").alias("event_type"), *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")], "mean", "sd", "tail")


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m FROM events)
    SELECT event_type, max(n) AS n, min(value) AS least, max(value) FILTER (i = n // 2) AS upper_median, max(value) FILTER (i = least(n - 1, CAST(ceil(n * 0.99::DOUBLE) AS BIGINT) - 1)) AS p99, max(value) AS most, round(max(m), 6) AS mean FROM s GROUP BY event_type""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank statistics: upper median and 99th percentile."""
    s = E.upper_stats(T.table(spark, sf_dir, "events"), "event_type", "value")
    return s.withColumn("mean", F.round("mean", 6))


@query("""WITH v AS (SELECT user_id % 500 AS item, event_type AS label, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, label) AS k FROM v)
    SELECT item, CASE WHEN votes >= 20 THEN label END AS label, votes FROM r WHERE k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent event type per user group; none below twenty votes."""
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("item"), F.col("event_type").alias("label"))
    return E.majority(e, "item", "label", 20)


@query("SELECT doc_id, CAST(('0x' || substr(sha256('7|' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.2 AS val FROM documents")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded, disjoint split by a hash of the id."""
    return E.seeded_split(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(1 / sqrt(n::DOUBLE), 8) AS weight, round((SELECT sum(n) FROM n) / (n * (SELECT count(*) FROM n))::DOUBLE, 6) AS class_weight FROM n")
def sampler_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse square-root frequency and balanced class weights."""
    n = T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_c")))
    return n.crossJoin(total).select("lang", "n", F.round(1 / F.sqrt("n"), 8).alias("weight"), F.round(F.col("_t") / (F.col("n") * F.col("_c")), 6).alias("class_weight"))


@query("""WITH d AS (SELECT user_id, event_id, value, extract(epoch FROM ts - lag(ts) OVER w) AS gap, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(sum(value * coalesce(round(gap), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS integral FROM d""".replace("extract(epoch FROM ts - lag(ts) OVER w)", "date_diff('microsecond', lag(ts) OVER w, ts) // 1000000").replace("round(gap)", "gap"))
def relevance_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running integral of value over the time since the previous event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, sf_dir, "events").withColumn("_p", F.lag("ts").over(w))
    gap = F.coalesce(F.expr("timestampdiff(SECOND, _p, ts)"), F.lit(0))
    return e.withColumn("_g", F.col("value") * gap).select("user_id", "event_id", F.round(F.sum("_g").over(w), 3).alias("integral"))


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER s AS before, lead(event_type) OVER s AS after, row_number() OVER s AS position FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT before, event_type, after, count(*) AS n FROM w WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between successive events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = T.table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))
    return t.where("before IS NOT NULL AND after IS NOT NULL").groupBy("before", "event_type", "after").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT a.event_id AS anchor, b.event_id AS later, b.i - a.i AS lag FROM p a JOIN p b ON a.user_id = b.user_id AND b.i > a.i AND b.i <= a.i + 3""")
def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the next three of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("anchor"), *[F.lead("event_id", k).over(w).alias(f"_{k}") for k in (1, 2, 3)])
    pairs = F.array(*[F.struct(F.col(f"_{k}").alias("later"), F.lit(k).cast("long").alias("lag")) for k in (1, 2, 3)])
    return e.select("anchor", F.inline(pairs)).where("later IS NOT NULL")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, k AS slot FROM r WHERE k <= 8""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T.table(spark, sf_dir, "events").withColumn("slot", F.row_number().over(w).cast("long")).where("slot <= 8").select("user_id", "event_id", "slot")


@query("""WITH t AS (SELECT user_id, event_type AS source, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
    n AS (SELECT *, lead(turn) OVER (PARTITION BY user_id, source ORDER BY turn) AS again FROM t)
    SELECT event_id, coalesce(max(CASE WHEN again > turn + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, source ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) = 1 AS later_needed FROM n""")
def later_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source comes back later after a turn without it."""
    turn = F.dense_rank().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = T.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source"), "event_id", turn.alias("turn"))
    w = Window.partitionBy("user_id", "source").orderBy("turn")
    n = t.withColumn("_again", F.lead("turn").over(w))
    gap = F.max(F.when(F.col("_again") > F.col("turn") + 1, 1).otherwise(0)).over(w.rowsBetween(0, Window.unboundedFollowing))
    return n.select("event_id", (gap == 1).alias("later_needed"))


@query("""WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) > 6 * 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions separated by six idle hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idle = F.expr("timestampdiff(MICROSECOND, _p, ts)") > 6 * 3_600_000_000
    e = T.table(spark, sf_dir, "events").withColumn("_p", F.lag("ts").over(w)).withColumn("_f", F.when(F.col("_p").isNull() | idle, 1).otherwise(0))
    return e.withColumn("session", F.sum("_f").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tumbling windows per event type."""
    e = T.table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 day").alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""WITH v AS (SELECT vec_id, {_UNIT} AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(s, 5) AS similarity FROM r WHERE rank <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten exact nearest neighbours; queries are the ids divisible by 100, against all rows."""
    v = V.valid_vectors(T.table(spark, sf_dir, "embeddings"), 64)
    found = V.knn(v, v.where("vec_id % 100 = 0"), 10, 64)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 5).alias("similarity"))


@query(f"""WITH v AS (SELECT label, unnest({_UNIT}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i::BIGINT AS i, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS sd FROM v GROUP BY ALL""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-pooled vectors and deviations per label and dimension."""
    v = T.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("_i", "_x"))
    g = v.groupBy("label", (F.col("_i") + 1).cast("long").alias("i"))
    return g.agg(F.round(F.avg(F.col("_x").cast("double")), 5).alias("mean"), F.round(F.stddev_pop(F.col("_x").cast("double")), 5).alias("sd"))


@query("""WITH m AS (SELECT o_custkey AS item, o_orderpriority AS topic, count(*) AS n FROM orders GROUP BY ALL)
    SELECT item, topic, n, CASE WHEN n > 3 THEN 'dense' WHEN n > 1 THEN 'moderate' ELSE 'sparse' END AS density FROM m""")
def topic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge density by count."""
    m = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("density", F.when(F.col("n") > 3, "dense").when(F.col("n") > 1, "moderate").otherwise("sparse"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus = 'F' AS gold, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    SELECT o_custkey AS query_id, avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END) = 1.0 AS "full" FROM c WHERE gold GROUP BY o_custkey""")
def top_three_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold rows among the first three, and full hits."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.rank().over(w).alias("r"), (F.col("o_orderstatus") == "F").alias("gold"))
    return E.top_recall(rows, "query_id", "r", "gold", 3)


@query("SELECT part, round(gap, 4) AS gap FROM (SELECT l_partkey AS part, max(l_extendedprice) FILTER (l_returnflag = 'R') - max(l_extendedprice) FILTER (l_returnflag <> 'R') AS gap FROM lineitem GROUP BY l_partkey) WHERE gap IS NOT NULL")
def gold_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best gold score less the best other one, per group."""
    li = T.table(spark, sf_dir, "lineitem")
    best = lambda c: F.max(F.when(c, F.col("l_extendedprice")))
    g = li.groupBy(F.col("l_partkey").alias("part")).agg((best(F.col("l_returnflag") == "R") - best(F.col("l_returnflag") != "R")).alias("gap"))
    return g.where("gap IS NOT NULL").select("part", F.round("gap", 4).alias("gap"))


@query("""WITH e AS (SELECT l_returnflag AS split, l_orderkey, l_linenumber, l_discount AS err FROM lineitem), m AS (SELECT split, quantile_cont(err, 0.5) AS med FROM e GROUP BY split)
    SELECT split, count(*) AS n, count(*) FILTER (err > med) AS forgotten FROM e JOIN m USING (split) GROUP BY split""")
def forgotten_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose error exceeds their split's median."""
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_discount").alias("err"))
    med = E.quantiles(li, "split", "err", {"_m": 0.5})
    return li.join(F.broadcast(med), "split").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("err") > F.col("_m"), 1)).alias("forgotten"))


@query("""SELECT n_regionkey AS region, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-way join with pre-aggregation by order."""
    li = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_r"))
    o = li.join(T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    c = o.join(T.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    n = c.join(T.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region")), "n_nationkey")
    return n.groupBy("region").agg(F.sum("_n").alias("n"), F.round(F.sum("_r"), 2).alias("revenue"))


@query()
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of the extended price on quantity, discount and tax."""
    w = E.ridge(T.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0)
    return spark.createDataFrame([(n, float(x)) for n, x in zip(["l_quantity", "l_discount", "l_tax", "intercept"], w, strict=True)], "feature string, weight double")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, label FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean norms."""
    v = T.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(F.sqrt(S.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), "label")
