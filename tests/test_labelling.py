"""Shards, taxonomies and gates on small tables, against plain code."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from memlattice.operators import shards as S
from memlattice.operators import taxonomy as O
from memlattice.operators import trials as V


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_the_first_shard_decides_and_half_scored_edges_have_no_score(spark):
    scores = [("c", 2, "ep_1", 0.9), ("c", 1, "ep_1", 0.4), ("c", 1, "E:x", 0.8), ("c", 1, "E:x", 0.6), ("c", 0, "E:y", None), ("c", 3, "E:y", 0.5), ("d", 7, "ep_1", 0.1), (None, 1, "E:z", 1.0), ("c", None, "E:z", 1.0), ("c", 1, None, 1.0)]
    nodes = S.node_scores(spark.createDataFrame(scores, "center string, shard long, node string, score double"))
    assert rows(nodes, "center", "node", "score") == [("c", "E:x", 0.6), ("c", "E:y", None), ("c", "ep_1", 0.4), ("d", "ep_1", 0.1)]
    edges = [("c", "ep_1", "has_entity", "E:x"), ("c", "ep_1", "has_entity", "E:x"), ("c", "ep_1", "has_entity", "E:y"), ("c", "ep_1", "state", "open"), ("d", "ep_1", "has_entity", "E:x")]
    scored = S.edge_scores(nodes, spark.createDataFrame(edges, "center string, s string, p string, o string"))
    assert rows(scored, "center", "s", "o", F.round("score", 9)) == [("c", "ep_1", "E:x", 0.5)]
    costs = spark.createDataFrame([("c", 1, 2.0), ("c", 2, None), ("d", 1, None), (None, 1, 5.0)], "center string, shard long, cost double")
    assert rows(S.shard_costs(costs), "center", "n_records", "cost") == [("c", 2, 2.0), ("d", 1, 0.0)]


def test_lists_follow_the_order_of_shards(spark):
    rng = random.Random(5)
    lists = {(c, k): [f"{c}{k}{i}" for i in range(rng.randrange(4))] for c in "abc" for k in range(40)}
    records = [(c, k, items or rng.choice([[], None])) for (c, k), items in lists.items()] + [(None, 1, ["x"]), ("a", None, ["x"])]
    rng.shuffle(records)
    got = S.joined_lists(spark.createDataFrame(records, "center string, shard long, items array<string>"))
    want = [(c, i, x) for c in "abc" for i, x in enumerate(x for k in range(40) for x in lists[c, k])]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert S.joined_lists(spark.createDataFrame([], "center string, shard long, items array<string>")).count() == 0


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_first_pairs_of_every_subgraph(spark, most):
    nodes = {"one": ["x"], "two": ["b", "a"], "ten": [f"n{i}" for i in range(10)], "many": [f"m{i:03d}" for i in range(60)]}
    table = [(c, n) for c, ns in nodes.items() for n in ns] + [("two", "a"), ("two", None), (None, "q")]
    got = S.pair_candidates(spark.createDataFrame(table, "center string, node string"), most)
    want = sorted((c, *pair) for c, ns in nodes.items() for pair in itertools.islice(itertools.combinations(sorted(ns), 2), most))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_groups_need_two_episodes_and_all_nodes_count_for_coherence(spark):
    weights = [("c", "ep_1", [0.7, 0.3]), ("c", "ep_2", [0.5, 0.5]), ("c", "E:x", [0.9, 0.1]), ("c", "ep_3", [0.1, 0.9]), ("c", "E:y", [0.2, 0.8]), ("c", "ep_4", None), ("c", "ep_5", []), ("d", "ep_1", [1.0])]
    groups, members = S.cluster_groups(spark.createDataFrame(weights, "center string, node string, weights array<double>"))
    assert rows(groups, "center", "cluster", "n_episodes", F.round("coherence", 9)) == [("c", 0, 2, 0.7)]
    assert rows(members, "center", "cluster", "node") == [("c", 0, "ep_1"), ("c", 0, "ep_2")]


def test_halves_of_a_taxonomy(spark):
    part = lambda *r: spark.createDataFrame(r, "class string, subclass string")
    got = O.merged_classes(part(("a", "b"), ("a", "c"), ("e", None)), part(("d", "b"), ("a", "b"), (None, "f"), ("b", "g")))
    assert rows(got, "class", "subclass") == sorted([("a", "b"), ("a", "c"), ("d", "b"), ("b", "g"), ("c", None), ("e", None), ("f", None), ("g", None)], key=repr)
    props = lambda *r: spark.createDataFrame(r, "name string, domain string, range string")
    assert rows(O.merged_properties(props(("p", "x", "y"), ("q", "x", "y")), props(("p", "z", None))), "name", "domain", "range") == [("p", "z", None), ("q", "x", "y")]


def test_members_of_deprecated_classes_move_one_level(spark):
    edges = [("m", "instanceOf", "old"), ("m", "instanceOf", "base"), ("n", "instanceOf", "old"), ("o", "instanceOf", "root"), ("q", "instanceOf", "kept"), ("old", "subClassOf", "mid"), ("old", "subClassOf", "base"), ("base", "subClassOf", "root"), ("n", "instanceOf", None)]
    out = O.reassigned(spark.createDataFrame(edges, "s string, p string, o string"), spark.createDataFrame([("old",), ("root",), ("base",), (None,)], "class string"))
    got = rows(out.where("p = 'instanceOf'"), "s", "o", "moved")
    assert got == [("m", "base", True), ("m", "root", True), ("n", "base", True), ("o", "root", False), ("q", "kept", False)]
    assert out.where("p = 'subClassOf'").count() == 3


def test_an_overlay_without_keys_fails(spark):
    table = lambda *r: spark.createDataFrame(r, "key string, value long")
    base, source = table(("a.x", 1), ("a.y", 2), ("b.x", 3)), table(("a.x", 9), ("a.z", 8), ("b.x", 7))
    assert rows(O.overlaid(base, source, ["a."]), "key", "value", "overlaid") == [("a.x", 9, True), ("a.y", 2, False), ("a.z", 8, True), ("b.x", 3, False)]
    assert O.overlaid(base, source, []).count() == 3
    with pytest.raises(ValueError, match="'c.'"):
        O.overlaid(base, source, ["a.", "c."])


def test_sweep_against_every_trial_at_every_value(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, 0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0])
    trials = [(some(), some(), some(), rng.choice([True, False, None])) for _ in range(400)]
    shipped, grid = {"theta": 0.6, "phi": 0.2, "cap": 0.8}, [0.1, 0.5, 0.9]
    got = V.threshold_sweep(spark.createDataFrame(trials, "relevance double, recoverability double, surprise double, covered boolean"), dict.fromkeys(shipped, grid), shipped)
    want = []
    for axis, value in itertools.product(shipped, grid):
        at = {**shipped, axis: value}
        fires = [None not in t[:3] and t[1] < at["theta"] and t[0] > at["phi"] and t[2] < at["cap"] for t in trials]
        covered = [bool(t[3]) for t in trials]
        on, off = sum(map(max, fires, covered)), sum(covered)
        want.append((axis, value, sum(fires), on, off, on - off, on - off))
    assert rows(got, "axis", "value", "firing", "coverage_on", "coverage_off", "delta", "rescued") == sorted(want, key=repr)


def test_selectivity_takes_the_last_probe_and_all_fillers(spark):
    scores = [(1, "a", "a", 0.2), (5, "a", "a", 0.9), (2, "a", None, 0.3), (3, "a", None, 0.5), (4, "a", "b", 1.0), (1, "b", None, 0.5), (4, "b", "b", 0.6), (1, "c", "c", 0.5), (9, "a", "a", None)]
    facts = V.selectivity(spark.createDataFrame(scores, "turn long, fact string, target string, relevance double"))
    assert rows(facts, "fact", "probe", "n_filler", F.round("gap", 9)) == [("a", 0.9, 2, 0.5), ("b", 0.6, 1, 0.1), ("c", 0.5, 0, None)]
    assert [(r.discriminates, round(r.min_gap, 9), r.n) for r in V.discriminates(facts).collect()] == [(False, 0.1, 2)]
    assert [tuple(r) for r in V.discriminates(facts.where("fact = 'a'")).select("discriminates", "n").collect()] == [(True, 1)]
    assert [tuple(r) for r in V.discriminates(facts.where("fact = 'c'")).collect()] == [(False, None, 0)]


@pytest.mark.parametrize("horizon", [12, 30])
def test_schedule_against_a_walk(spark, horizon):
    facts, fillers = {"s": ["a"], "t": [f"f{i}" for i in range(9)]}, ["u?", "v?", "w?"]
    order = lambda xs: sorted(xs, key=lambda x: hashlib.sha256(f"3|{x}".encode()).hexdigest())
    want = []
    for center, names in facts.items():
        start, n = max(8, horizon // 4), len(names)
        step = max(4, (horizon - start - 2) // max(1, n - 1)) if n > 1 else 1
        at = {min(start + i * step, horizon - 1): f for i, f in enumerate(order(names))}
        want += [(center, t, at.get(t), None if t in at else order(fillers)[t % 3]) for t in range(horizon)]
    table = spark.createDataFrame([(c, f) for c, fs in facts.items() for f in fs + fs[:1]] + [("s", None), (None, "z")], "center string, fact string")
    assert rows(V.probe_schedule(table, fillers, horizon, 3), "center", "turn", "fact", "filler") == sorted(want, key=repr)


def test_routes_count_over_prediction_against_them(spark):
    kind = "struct<pathway: string, domains: array<string>, size: string, deliberates: boolean>"
    routes = [(("a", ["x", "far"], "s", None), ("a", ["x", "y", "y"], "l", False)), (("a", None, "s", True), ("b", [], "s", True)), (("b", ["far"], "s", True), ("b", ["x"], "s", False))]
    table = spark.createDataFrame(routes, f"want {kind}, got {kind}")
    r = V.routing_accuracy(table, F.array(F.lit("x"), F.lit("y"))).first()
    parts = (2 / 3, (2 / 3 + 1 + 0) / 3, 2 / 3, 2 / 3)
    assert [round(r[c] - p, 9) for c, p in zip(("pathway", "domain", "size", "deliberation"), parts, strict=True)] == [0, 0, 0, 0]
    assert abs(r.accuracy - sum(w * p for w, p in zip((0.35, 0.30, 0.20, 0.15), parts, strict=True))) < 1e-9 and r.n == 3
    assert V.routing_accuracy(table.limit(0)).first().accuracy is None


def test_a_head_with_one_class_falls_back_to_accuracy(spark):
    scores = [("two", 0.9, 1.0), ("two", 0.2, 0.0), ("two", 0.6, 0.0), ("two", 0.6, 1.0), ("one", 0.5, 1.0), ("one", 0.8, 1.0), ("one", None, 1.0)]
    got = rows(V.head_metrics(spark.createDataFrame(scores, "head string, score double, label double")), "head", "n", F.round("mae", 9), "accuracy", "quality")
    assert got == [("one", 2, 0.35, 0.5, 0.5), ("two", 4, 0.325, 0.75, 0.875)]
