"""Planted anomalies: seeded requests per subgraph, nine injectors, nine detectors, recall and decision budgets.

A subgraph is the rows of one center: nodes (center, node, content) and edges (center, s, p, o).  All subgraphs are changed
together; whatever is picked in one is the candidate of the least seeded hash, a minimum that combines before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import text as X
from memlattice.operators.evaluation import hash_order
from memlattice.operators.flagged import first_of_each, is_node
from memlattice.operators.graph import propagate_labels, union_all
from memlattice.sources.sinks import materialised

#: Kinds of anomaly, in the order in which they are planted.
KINDS = ("contradictory_state", "duplicate_episode", "duplicate_decision", "orphan_decision", "detached_episode", "broken_follows", "type_violation", "isolated_cluster", "stale_abstraction")
#: Edges that hold a subgraph together, and what kinds of node some of them join.
LINKS = ("has_session", "in_session", "has_entity", "has_topic", "has_decision", "follows")
DOMAINS = {"has_entity": ("episode", "entity"), "has_topic": ("episode", "topic"), "has_decision": ("episode", "decision"), "follows": ("episode", "episode"), "in_session": ("episode", "session")}
MISSING = "ep_999999"


def requested(centers: DataFrame, seed: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(center, kind): for each center a seeded number, 0 to all, of seeded kinds; centers that get none have no row."""
    many = F.pmod(F.conv(F.substring(hash_order(F.col("center"), seed), 1, 8), 16, 10).cast("long"), F.lit(len(kinds) + 1)).cast("int")
    drawn = F.array_sort(F.array(*[F.struct(hash_order(F.concat(F.col("center"), F.lit(f"|{k}")), seed).alias("h"), F.lit(k).alias("kind")) for k in kinds]))
    some = F.transform(F.slice(drawn, F.lit(1), many), lambda x: x["kind"])
    return centers.where("center IS NOT NULL").select("center").distinct().select("center", F.explode(some).alias("kind"))


def _picked(candidates: DataFrame, requests: DataFrame, kind: str, seed: int, *columns: str) -> DataFrame:
    """One row of `columns` per center that asks for the kind and has a candidate."""
    wanted = requests.where(F.col("kind") == kind).select("center")
    order = hash_order(F.concat_ws("|", "center", F.lit(kind), *columns), seed)
    best = candidates.join(wanted, "center", "left_semi").groupBy("center").agg(F.min(F.struct(order.alias("_h"), *columns)).alias("_b"))
    return best.select("center", *[F.col(f"_b.{c}").alias(c) for c in columns])


def _edge(rows: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return rows.select("center", s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges less the links that begin or end in given nodes of their subgraph."""
    linking = edges.where(F.col("p").isin(*LINKS))
    for end in ("s", "o"):
        linking = linking.join(nodes.select("center", F.col("node").alias(end)), ["center", end], "left_anti").select("center", "s", "p", "o")
    return linking.unionByName(edges.where(~F.col("p").isin(*LINKS)))


def inject(nodes: DataFrame, edges: DataFrame, requests: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, planted): subgraphs with one anomaly of each requested kind, and (center, node, kind) of what was planted.

    A kind whose candidate a subgraph has not, and a center without nodes, are left out.  Clones are made first and take their original's links, then links are
    stripped, then a follows edge that is left is broken, then edges and nodes are added, so a later anomaly may undo an
    earlier one (an orphan can be given an edge), as in any sequence of accidents.  Nodes and edges are written once and read by all that follows.
    """
    nodes = materialised(nodes.where("center IS NOT NULL AND node IS NOT NULL").groupBy("center", "node").agg(F.min("content").alias("content")))
    edges = materialised(edges.where("center IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("center", "s", "p", "o").distinct())
    asked = materialised(requests.select("center", "kind").distinct().join(nodes.select("center").distinct(), "center", "left_semi"))
    of = lambda prefix, table=nodes: table.where(F.col("node").startswith(prefix))
    planted = {}

    # clones and contradictions
    told = _picked(of("E:"), asked, KINDS[0], seed, "node")
    planted[KINDS[0]] = told
    twin = F.concat("node", F.lit("_dup"))
    episode = _picked(of("ep_").where("content <> ''"), asked, KINDS[1], seed, "node", "content")
    decision = _picked(of("D:"), asked, KINDS[2], seed, "node").join(nodes, ["center", "node"])
    clones = materialised(union_all([df.select("center", "node", twin.alias("clone"), F.coalesce("content", F.substring("node", 3, 1 << 20)).alias("content"), F.lit(k).alias("kind")) for df, k in ((episode, KINDS[1]), (decision, KINDS[2]))]))
    clones = clones.join(nodes.select("center", F.col("node").alias("clone")), ["center", "clone"], "left_anti")
    for k in KINDS[1:3]:
        some = clones.where(F.col("kind") == k)
        planted[k] = some.select("center", "node").unionByName(some.select("center", F.col("clone").alias("node")))
    ties = edges.where(F.col("p").isin(*LINKS))
    ahead = clones.where(F.col("kind") == KINDS[1]).withColumnRenamed("node", "s").join(ties, ["center", "s"]).select("center", F.col("clone").alias("s"), "p", "o")
    behind = clones.withColumnRenamed("node", "o").join(ties, ["center", "o"]).where(f"kind = '{KINDS[1]}' OR p = 'has_decision'").select("center", "s", "p", F.col("clone").alias("o"))
    linked = behind.where("p = 'has_decision'").select("center", F.col("o").alias("clone"))
    first = of("ep_").groupBy("center").agg(F.min("node").alias("_e"))
    lonely = clones.where(F.col("kind") == KINDS[2]).join(linked, ["center", "clone"], "left_anti").join(first, "center")
    said = [_edge(told, F.col("node"), "state", F.lit(v)) for v in ("planted open", "planted shut")]
    grown = materialised(union_all([edges, ahead, behind, _edge(lonely, F.col("_e"), "has_decision", F.col("clone")), *said]).distinct())
    nodes = materialised(nodes.unionByName(clones.select("center", F.col("clone").alias("node"), "content")))

    # links stripped, then a follows edge broken
    orphan = _picked(of("D:", nodes), asked, KINDS[3], seed, "node")
    detached = _picked(of("ep_", nodes).where("node <> center"), asked, KINDS[4], seed, "node")
    planted[KINDS[3]], planted[KINDS[4]] = orphan, detached
    stripped = materialised(_without(grown, orphan.unionByName(detached)))
    broken = materialised(_picked(stripped.where("p = 'follows'"), asked, KINDS[5], seed, "s", "o"))
    planted[KINDS[5]] = broken.select("center", F.col("s").alias("node"))
    left = stripped.join(broken.withColumn("p", F.lit("follows")), ["center", "s", "p", "o"], "left_anti")

    # what is added
    wrong = _picked(of("E:", nodes), asked, KINDS[6], seed, "node").join(_picked(of("D:", nodes), asked, KINDS[6], seed, "node").withColumnRenamed("node", "_d"), "center")
    planted[KINDS[6]] = wrong.select("center", "node")
    name = F.substring(hash_order(F.concat("center", F.lit("|new")), seed), 1, 12)
    apart = asked.where(F.col("kind") == KINDS[7]).select("center", F.concat(F.lit("ep_iso_"), name).alias("a"), F.concat(F.lit("E:iso_"), name).alias("b"), F.concat(F.lit("E:iso2_"), name).alias("c"))
    stale = asked.where(F.col("kind") == KINDS[8]).select("center", F.concat(F.lit("M:"), name).alias("node"))
    planted[KINDS[7]], planted[KINDS[8]] = apart.select("center", F.explode(F.array("a", "b", "c")).alias("node")), stale
    more = [_edge(broken, F.col("s"), "follows", F.lit(MISSING)), _edge(wrong, F.col("node"), "has_decision", F.col("_d")), _edge(stale, F.col("node"), "abstracts", F.lit(MISSING))]
    more += [_edge(apart, F.col("a"), "has_entity", F.col(c)) for c in ("b", "c")]
    new = planted[KINDS[7]].unionByName(planted[KINDS[8]]).withColumn("content", F.lit(None).cast("string"))
    record = union_all([df.select("center", "node", F.lit(k).alias("kind")) for k, df in planted.items()])
    return materialised(nodes.unionByName(new)), materialised(union_all([left, *more]).distinct()), materialised(record.distinct())


def detect(nodes: DataFrame, edges: DataFrame, domains: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(center, node, kind) of the nine rules.

    * contradictory_state: a node with two literal states or more;
    * duplicate_episode, duplicate_decision: another of the same subgraph has the same set of word tokens (a
      decision without content is its name);
    * orphan_decision, detached_episode: no link begins or ends in it; * broken_follows: it follows what is no node;
    * type_violation: an end of an edge whose kind its declared property does not allow;
    * isolated_cluster: in a component of two nodes or more over the links that the center is not in;
    * stale_abstraction: it abstracts what is no node.

    Nodes and edges are written once and read by the rules; rules on predicates share a pass over the edges.
    """
    nodes = materialised(nodes.where("center IS NOT NULL AND node IS NOT NULL").groupBy("center", "node").agg(F.min("content").alias("content")))
    edges = materialised(edges.where("center IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("center", "s", "p", "o"))
    links = edges.where(F.col("p").isin(*LINKS))
    named = lambda df, kind: df.select("center", "node", F.lit(kind).alias("kind")).distinct()
    ends = links.select("center", F.explode(F.array("s", "o")).alias("node")).distinct()
    states = edges.where((F.col("p") == "state") & ~is_node(F.col("o"))).groupBy("center", F.col("s").alias("node")).agg(F.countDistinct("o").alias("_n")).where("_n > 1")
    out = [named(states, KINDS[0])]
    for prefix, kind, text in (("ep_", KINDS[1], F.col("content")), ("D:", KINDS[2], F.coalesce("content", F.substring("node", 3, 1 << 20)))):
        tokens = X.word_tokens(text)
        signed = nodes.where(F.col("node").startswith(prefix)).select("center", "node", F.when(F.size(tokens) > 0, F.sha2(F.array_join(F.array_sort(tokens), " "), 256)).alias("_h")).where("_h IS NOT NULL")
        twice = signed.groupBy("center", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        out.append(named(signed.join(twice, ["center", "_h"], "left_semi"), kind))
    alone = nodes.join(ends, ["center", "node"], "left_anti")
    out += [named(alone.where("node LIKE 'D:%'"), KINDS[3]), named(alone.where("startswith(node, 'ep_')"), KINDS[4])]
    dead = edges.where("p IN ('follows', 'abstracts')").join(nodes.select("center", F.col("node").alias("o")), ["center", "o"], "left_anti")
    out.append(dead.select("center", F.col("s").alias("node"), F.when(F.col("p") == "follows", KINDS[5]).otherwise(KINDS[8]).alias("kind")).distinct())
    wrong = F.array().cast("array<string>")  # the ends of an edge that its property does not allow
    for p, (domain, reach) in (domains or DOMAINS).items():
        bad = [F.when(X.node_kind(F.col("s")) != domain, F.col("s")), F.when(is_node(F.col("o")) & (X.node_kind(F.col("o")) != reach), F.col("o"))]
        wrong = F.when(F.col("p") == p, F.array_compact(F.array(*bad))).otherwise(wrong)
    out.append(named(edges.select("center", F.explode(wrong).alias("node")), KINDS[6]))
    inside = links.join(nodes.select("center", F.col("node").alias("s")), ["center", "s"], "left_semi").join(nodes.select("center", F.col("node").alias("o")), ["center", "o"], "left_semi")
    key = lambda c: F.concat_ws("\u0001", "center", c)
    labels = propagate_labels(inside.where("s <> o").select(key("s").alias("s"), key("o").alias("o")))
    placed = nodes.withColumn("_k", key("node")).join(labels.select(F.col("node").alias("_k"), "component"), "_k").select("center", "node", "component")
    own = placed.where("node = center").select("center", F.col("component").alias("_own"))
    out.append(named(placed.join(own, "center", "left").where("_own IS NULL OR component <> _own"), KINDS[7]))
    return union_all(out).distinct()


def recall_by_kind(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, planted, detected, recall) of planted anomalies."""
    both = planted.join(found.withColumn("_hit", F.lit(1)), ["center", "node", "kind"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("planted"), F.count("_hit").alias("detected"))
    return both.withColumn("recall", F.col("detected") / F.col("planted"))


def decision_budget(drift: DataFrame, anomalies: DataFrame, most: int, seed: int) -> DataFrame:
    """(center, node, kind): at most `most` findings per center to be decided, in a seeded order.

    Findings of drift (center, node) get up to half of the budget, one at least; anomalies (center, node, kind) the rest.  A center with a
    third of all findings is cut in salted parts before its own order is taken.
    """
    if most <= 0:
        return anomalies.where("false").select("center", "node", "kind")
    order = F.struct(hash_order(F.concat_ws("|", "node", "kind"), seed).alias("h"), "node", "kind")
    wandering = first_of_each(drift.select("center", "node", F.lit("identity_drift").alias("kind")).distinct().withColumn("_o", order), "center", "_o", max(1, most // 2))
    used = wandering.groupBy("center").agg(F.count(F.lit(1)).alias("_used"))
    rest = first_of_each(anomalies.select("center", "node", "kind").distinct().withColumn("_o", order), "center", "_o", most)
    rest = rest.join(used, "center", "left").withColumn("_place", F.row_number().over(Window.partitionBy("center").orderBy("_o")))  # `most` rows a center at most
    rest = rest.where(F.col("_place") <= most - F.coalesce("_used", F.lit(0)))
    return wandering.select("center", "node", "kind").unionByName(rest.select("center", "node", "kind"))

