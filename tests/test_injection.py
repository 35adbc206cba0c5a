"""Planted anomalies: what is requested, planted, found and decided, against plain code."""

import hashlib
import random
from collections import defaultdict

import pytest

from memlattice.operators import injection as J


@pytest.fixture(scope="module")
def graph():
    """Forty subgraphs of a user, a session, five episodes in a row, decisions and entities."""
    rng = random.Random(7)
    nodes, edges = [], []
    for k in range(40):
        c = f"U:{k}"
        nodes += [(c, c, None), (c, f"S:{k}", None)]
        edges.append((c, c, "has_session", f"S:{k}"))
        for i in range(5):
            ep = f"ep_{k:03d}_{i}"
            nodes += [(c, ep, f"summary {k} {i} {rng.random()}"), (c, f"D:{k}.{i}", f"decided {k} {i} {rng.random()}"), (c, f"E:{k}.{i % 3}", None)]
            edges += [(c, ep, "in_session", f"S:{k}"), (c, ep, "has_decision", f"D:{k}.{i}"), (c, ep, "has_entity", f"E:{k}.{i % 3}")]
            if i:
                edges.append((c, ep, "follows", f"ep_{k:03d}_{i - 1}"))
    return nodes + nodes[:5], edges + edges[:5]


@pytest.fixture(scope="module")
def tables(spark, graph):
    nodes = spark.createDataFrame([*graph[0], (None, "ep_x", "t"), ("U:0", None, "t")], "center string, node string, content string")
    return nodes, spark.createDataFrame([*graph[1], ("U:0", None, "follows", "ep_1")], "center string, s string, p string, o string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_requests_are_seeded(spark, tables):
    got = defaultdict(list)
    for c, k in rows(J.requested(tables[0].select("center"), 3)):
        got[c].append(k)
    for i in range(40):
        c = f"U:{i}"
        n = int(hashlib.sha256(f"3|{c}".encode()).hexdigest()[:8], 16) % 10
        order = sorted(J.KINDS, key=lambda k: hashlib.sha256(f"3|{c}|{k}".encode()).hexdigest())
        assert sorted(got[c]) == sorted(order[:n])


def test_a_clean_graph_has_no_anomaly(tables):
    assert rows(J.detect(*tables)) == set()


@pytest.mark.parametrize("kind", J.KINDS)
def test_each_kind_alone_is_found_and_nothing_else(spark, tables, kind):
    nodes, edges = (t.where("center IN ('U:1', 'U:2', 'U:3')") for t in tables)
    wanted = spark.createDataFrame([("U:1", kind), ("U:3", kind), ("U:3", kind), ("U:none", kind)], "center string, kind string")
    after, linked, planted = J.inject(nodes, edges, wanted, 5)
    want = rows(planted)
    assert {c for c, _, _ in want} == {"U:1", "U:3"} and {k for _, _, k in want} == {kind}
    found = rows(J.detect(after, linked))
    assert want <= found
    # a detached episode leaves its decision without a link, which is found as well
    assert {k for _, _, k in found - want} == ({"orphan_decision"} if kind == "detached_episode" else set())
    untouched = linked.where("center = 'U:2'")
    assert rows(untouched) == {r for r in rows(edges.distinct()) if r[0] == "U:2"}


def test_all_kinds_together_and_recall(spark, tables):
    nodes, edges = tables
    wanted = J.requested(nodes.select("center"), 11)
    after, linked, planted = J.inject(nodes, edges, wanted, 11)
    assert rows(planted) == rows(J.inject(nodes.repartition(3), edges.repartition(5), wanted, 11)[2])
    found, want = rows(J.detect(after, linked)), rows(planted)
    per_kind = {r.kind: (r.planted, r.detected) for r in J.recall_by_kind(planted, J.detect(after, linked)).collect()}
    assert set(per_kind) == set(J.KINDS)
    for k in J.KINDS:
        mine = {r for r in want if r[2] == k}
        assert per_kind[k] == (len(mine), len(mine & found))
    for k in ("contradictory_state", "duplicate_episode", "duplicate_decision", "broken_follows", "type_violation", "isolated_cluster", "stale_abstraction"):
        assert per_kind[k][0] == per_kind[k][1] > 0
    assert sum(d for _, d in per_kind.values()) >= 0.9 * len(want)


def test_no_candidates_and_empty_tables(spark, tables):
    nodes = spark.createDataFrame([("c", "c", None)], "center string, node string, content string")
    edges = tables[1].limit(0)
    wanted = spark.createDataFrame([("c", k) for k in J.KINDS], "center string, kind string")
    _, linked, planted = J.inject(nodes, edges, wanted, 1)
    assert {k for _, _, k in rows(planted)} == {"isolated_cluster", "stale_abstraction"} and linked.count() == 3
    after, linked, planted = J.inject(nodes.limit(0), edges, wanted.limit(0), 1)
    assert after.count() == linked.count() == planted.count() == 0


def test_budget_keeps_both_sides(spark):
    drift = [("a", f"E:{i}") for i in range(10)] + [("b", "E:1")]
    anomalies = [(c, f"ep_{i}", "k") for c, n in (("a", 10), ("b", 2), ("c", 9)) for i in range(n)]
    d, a = spark.createDataFrame(drift, "center string, node string"), spark.createDataFrame(anomalies, "center string, node string, kind string")
    order = lambda node, kind: hashlib.sha256(f"4|{node}|{kind}".encode()).hexdigest()
    for most in (0, 1, 5):
        want = set()
        for c in "abc":
            mine = sorted((n for x, n in drift if x == c), key=lambda n: order(n, "identity_drift"))[: max(1, most // 2) if most else 0]
            rest = sorted(((n, k) for x, n, k in anomalies if x == c), key=lambda r: order(*r))[: max(0, most - len(mine))]
            want |= {(c, n, "identity_drift") for n in mine} | {(c, *r) for r in rest}
        assert rows(J.decision_budget(d, a, most, 4)) == want


def test_subgraphs_are_read_once(spark, tables):
    read = [spark.sparkContext.accumulator(0) for _ in tables]

    def counted(df, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    nodes, edges = (counted(df, seen) for df, seen in zip(tables, read, strict=True))
    wanted = J.requested(tables[0].select("center"), 7)
    J.inject(nodes, edges, wanted, 7)[2].count()
    assert [seen.value for seen in read] == [df.count() for df in tables]
    J.detect(nodes, edges).count()
    assert [seen.value for seen in read] == [2 * df.count() for df in tables]
