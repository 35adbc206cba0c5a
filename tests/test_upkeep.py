"""The consolidation pass and flagged contexts on small tables, against plain code."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memlattice.operators import dream as D
from memlattice.operators import flagged as G

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2026, 1, 1)
RULES = D.Rules(("tie",), half_life=10.0, faded=0.2, dull=0.3, deep_after=365, sure=0.8)


def tables(spark):
    edges = [("a", "tie", "b"), ("a", "tie", "c"), ("b", "tie", "c"), ("d", "tie", "e"), ("u", "state", "x"), ("u", "state", "y"), ("v", "state", "x"), ("a", "follows", "b"), ("old", "tie", "gone"), ("a", "tie", "b"), (None, "tie", "b")]
    seen = {("a", "tie", "b"): T0 - 5 * DAY, ("a", "tie", "c"): T0 - 40 * DAY, ("d", "tie", "e"): T0 - 40 * DAY, ("u", "state", "x"): T0 - 2 * DAY, ("u", "state", "y"): T0 - DAY, ("v", "state", "x"): T0, ("b", "tie", "c"): T0 + DAY}
    side = [(*k, "current", 1.0, t, None) for k, t in seen.items()] + [("old", "tie", "gone", "archived", 0.01, T0 - 500 * DAY, T0 - 400 * DAY), ("u", "state", "x", "superseded", 1.0, T0 - 90 * DAY, T0)]
    score = [("a", 0.9), ("b", 0.2), ("c", 0.8), ("d", 0.1), ("e", 0.1)]
    return D.Memory(
        spark.createDataFrame(edges, "s string, p string, o string"),
        spark.createDataFrame(side, "s string, p string, o string, state string, strength double, seen timestamp, until timestamp"),
        spark.createDataFrame(score, "node string, score double"),
        spark.createDataFrame([], "s string, p string, o string, reason string"),
    ), spark.createDataFrame([("p", "tie", "q", 0.8), ("p", "tie", "r", 0.79), ("a", "tie", "b", 0.99), ("p", "tie", "q", 0.9)], "s string, p string, o string, score double")


WANT = {("u", "state", "x"): "supersede", ("old", "tie", "gone"): "remove", ("d", "tie", "e"): "prune", ("a", "tie", "c"): "archive", ("a", "tie", "b"): "decay", ("p", "tie", "q"): "propose"}


def test_a_pass_decides_once_per_edge_and_a_dry_run_changes_nothing(spark):
    memory, candidates = tables(spark)
    decided, after = D.consolidate(memory, candidates, RULES, F.lit(T0))
    got = {(r.s, r.p, r.o): r for r in decided.collect()}
    assert {k: r.action for k, r in got.items()} == WANT and after is memory
    assert abs(got["a", "tie", "b"].strength - 0.5**0.5) < 1e-9 and abs(got["a", "tie", "c"].strength - 0.5**4) < 1e-9
    assert {r.action: r.n for r in D.decision_counts(decided).collect()} == dict.fromkeys(WANT.values(), 1)


def test_versions_repeat_and_go_on(spark, tmp_path):
    memory, candidates = tables(spark)
    folder = f"{tmp_path}/memory"
    assert D.newest_version(spark, folder) is None
    _, one = D.consolidate(memory, candidates, RULES, F.lit(T0), folder)
    edges = {(r.s, r.p, r.o) for r in one.edges.collect()}
    assert ("p", "tie", "q") in edges and not {("d", "tie", "e"), ("old", "tie", "gone")} & edges and D.newest_version(spark, folder) == 0
    assert {(r.s, r.reason) for r in one.archive.collect()} == {("d", "prune"), ("old", "remove")}
    side = {(r.s, r.p, r.o): r for r in one.sidecar.collect()}
    assert side["u", "state", "x"].state == "superseded" and side["a", "tie", "c"].state == "archived" and side["a", "tie", "c"].until == T0
    again, two = D.consolidate(one, candidates, RULES, F.lit(T0), folder)
    assert again.count() == 0 and D.newest_version(spark, folder) == 1
    for name in D.Memory._fields:
        old, new = (sorted(map(str, getattr(m, name).distinct().collect())) for m in (one, two))
        assert old == new
    later, _ = D.consolidate(two, candidates, RULES, F.lit(T0 + 365 * DAY))
    assert {(r.s, r.p, r.o): r.action for r in later.collect()}["a", "tie", "c"] == "remove"
    (tmp_path / "memory" / "version=7").mkdir()  # a pass that died
    _, _ = D.consolidate(two, candidates, RULES, F.lit(T0), folder)
    assert D.newest_version(spark, folder) == 8


def test_an_empty_memory(spark):
    memory, candidates = tables(spark)
    empty = D.Memory(*[t.limit(0) for t in memory])
    decided, _ = D.consolidate(empty, candidates.limit(0), RULES, F.lit(T0))
    assert decided.count() == 0


def test_flagged_context_against_a_walk(spark):
    rng = random.Random(9)
    ids = [f"ep_{i:03d}" for i in range(60)] + [f"E:{i}" for i in range(10)]
    content = {n: rng.choice(["same", "other", "", None]) for n in ids} | {f"ep_{i:03d}": "hot" for i in range(40, 60)}
    edges = {(rng.choice(ids), "p", rng.choice([*ids, "literal", "word"])) for _ in range(120)}
    flags = ["ep_001", "ep_041", "E:3", "ep_059", "ep_missing"]
    nodes = spark.createDataFrame([("c", n, t) for n, t in content.items()] + [("other", "ep_zzz", "hot"), ("c", None, "hot")], "center string, node string, content string")
    table = spark.createDataFrame([("c", *e) for e in edges] + [("c", None, "p", "ep_001"), ("c", *min(edges))], "center string, s string, p string, o string")
    asked = spark.createDataFrame([("c", f) for f in [*flags, None, "ep_001"]], "center string, flag string")
    members, found = G.flagged_context(asked, nodes, table)
    got = {f: {} for f in flags}
    for r in members.collect():
        got[r.flag][r.node] = r.role
    links = {f: {(r.s, r.p, r.o) for r in found.where(F.col("flag") == f).collect()} for f in flags}
    node = lambda x: x.startswith(("ep_", "E:"))
    for f in flags:
        want = {f: "self"}
        for s, _, o in edges:
            if node(o) and f in (s, o):
                want.setdefault(o if s == f else s, "neighbour")
        kind = lambda n: n[:2]
        twins = sorted(n for n in ids if n != f and content.get(f) and content[n] == content.get(f) and kind(n) == kind(f))[:8]
        for t in twins:
            want.setdefault(t, "twin")
        assert got[f] == want
        assert links[f] == {e for e in edges if e[0] in want and (not node(e[2]) or e[2] in want)}
    assert sum(r == "twin" for r in got["ep_041"].values()) in range(1, 9)


def test_enriched_leaves_superseded_states_out(spark):
    nodes = spark.createDataFrame([("c", "ep_1"), ("c", "M:1"), ("c", "ep_1")], "center string, node string")
    edges = spark.createDataFrame([("c", "ep_1", "has_entity", "E:a")], "center string, s string, p string, o string")
    store = spark.createDataFrame([("M:1", "abstracts", "ep_1"), ("M:0", "supersedes", "M:1"), ("ep_1", "state", "old"), ("ep_1", "state", "new"), ("ep_9", "state", "new"), ("ep_1", "has_tone", "A:x")], "s string, p string, o string")
    gone = spark.createDataFrame([("ep_1", "state", "old"), ("M:1", "abstracts", "ep_1")], "s string, p string, o string")
    said = spark.createDataFrame([("ep_1", "text")], "node string, summary string")
    n, e = G.enriched(nodes, edges, store, gone, said)
    assert {(r.node, r.summary) for r in n.collect()} == {("ep_1", "text"), ("M:1", None)} and n.count() == 2
    assert sorted((r.s, r.p, r.o) for r in e.collect()) == [("M:0", "supersedes", "M:1"), ("M:1", "abstracts", "ep_1"), ("ep_1", "has_entity", "E:a"), ("ep_1", "state", "new")]
