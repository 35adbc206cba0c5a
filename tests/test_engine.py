"""Operators against naive models, and registered queries against DuckDB."""

import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from memlattice import catalog
from memlattice.functions import language as N
from memlattice.functions import scoring as S
from memlattice.functions import text as X
from memlattice.operators import documents as D
from memlattice.operators import evaluation as E
from memlattice.operators import graph as G
from memlattice.operators import lifecycle as L
from memlattice.operators import retrieval as R
from memlattice.sources import parsers as P
from memlattice.sources import sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert [repr(r) for r in got] == [repr(r) for r in want]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_decay_constants(spark):
    rate = lambda r, n, recent: one(spark, S.retrieval_rate(F.lit(r), F.lit(n), F.lit(recent), F.lit(1.0)))
    assert rate(0.01, 0, 1) == pytest.approx(0.0095)
    assert rate(0.01, 6, 7) == pytest.approx(0.0102) and rate(0.0499, 9, 9) == pytest.approx(0.05)
    assert one(spark, S.dream_score(F.lit(1.0), F.lit(0.5), F.lit(2.0))) == 0.25


def test_feedback_compounds_and_clamps(spark):
    rows = spark.createDataFrame([("u", i, 5) for i in range(4)] + [("w", 0, 9), ("a/b", 0, 5)], "unit string, position int, rating int")
    got = {n: {r.unit: r.value for r in L.compounded_boost(rows.where(f"position < {n}")).collect()} for n in (1, 2, 3, 4)}
    assert [got[n]["u"] for n in (1, 2, 3, 4)] == [1.5, 2.25, 3.375, 4.0] and set(got[4]) == {"u"}


def test_bfs_and_components_against_a_walk(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randint(0, 60):02d}", "p", f"n{rng.randint(0, 60):02d}") for _ in range(50)]
    edges = spark.createDataFrame(pairs, "s string, p string, o string")
    near = defaultdict(set)
    for a, _, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    reached = {(r.center, r.node): r.depth for r in G.bounded_bfs(spark.createDataFrame([("n01",), ("n07",)], "node string"), G.undirected(edges), 3).collect()}
    for c in ("n01", "n07"):
        depth, frontier = {c: 0}, [c]
        for d in (1, 2, 3):
            frontier = [x for n in frontier for x in near[n] if x not in depth and not depth.update({x: d})]
        assert {n: d for (k, n), d in reached.items() if k == c} == depth
    got = {r.node: r.component for r in G.propagate_labels(edges.where("s <> o").select("s", "o")).collect()}
    for n in [x for x in near if near[x]]:
        seen, todo = {n}, [n]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[n] == min(seen)


def test_current_edges_default_to_current(spark):
    edges = spark.createDataFrame([("a", "p", "b"), ("a", "p", "c")], "s string, p string, o string")
    meta = spark.createDataFrame([("a", "p", "c", "archived")], "s string, p string, o string, state string")
    assert [r.o for r in G.current_edges(edges, meta).collect()] == ["b"]


def test_diversity_cap(spark):
    rows = [("q", f"i{i}", "a" if i < 6 else "b", 10.0 - i) for i in range(8)]
    got = R.diverse(spark.createDataFrame(rows, "query_id string, id string, kind string, score double")).orderBy("position").collect()
    assert [r.kind for r in got] == ["a", "a", "a", "b", "a", "a", "a", "b"]


def test_packing_prefix_and_skip(spark):
    rows = spark.createDataFrame([("s", i, f"i{i}", c) for i, c in enumerate([50, 80, 40, 5])], "k string, position int, id string, cost long")
    assert [r.id for r in R.packed_prefix(rows, "k", [F.col("position")], "cost", 100).collect()] == ["i0"]
    assert R.packed_skip(rows, "k", "cost", 100, 9).first().ids == ["i0", "i2", "i3"]


def test_text_functions(spark):
    assert one(spark, X.safe_key(F.lit("a/b"))).startswith("h_") and one(spark, X.safe_key(F.lit("ab"))) == "ab"
    assert one(spark, X.normal_title(F.lit("  The  Plan! "))) == "the plan"
    assert one(spark, X.node_kind(F.lit("doc_000001_sec_002"))) == "section"
    assert one(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, X.collapsed_subject(F.lit("Re: FW:  Budget"))) == "budget"
    assert one(spark, X.blank_to_null(F.lit(" null "))) is None


def test_language_functions(spark):
    prompt = F.lit("What did Alice and Bob say together before the launch last week in March to May?")
    assert one(spark, N.prompt_entities(prompt)) == ["Alice", "Bob", "March", "May"]
    assert one(spark, N.entity_mode(prompt)) == "intersection" and one(spark, N.temporal_bucket(prompt)) == "last_week"
    assert one(spark, N.anchor_word(prompt, "before")) == "launch" and one(spark, N.anchor_word(prompt, "after")) is None
    first, last = N.month_range(prompt, 2026)
    assert (str(one(spark, first)), str(one(spark, last))) == ("2026-03-01", "2026-05-31")
    assert tuple(one(spark, N.assertion(F.lit("The owner: Alice.")))) == ("owner", "Alice")
    assert tuple(one(spark, N.assertion(F.lit("status is now blocked")))) == ("status", "blocked")
    assert tuple(one(spark, N.assertion(F.lit("plan changed to B")))) == ("plan", "B")
    assert one(spark, N.assertion(F.lit("nothing here"))) is None
    assert one(spark, N.temporal_features(F.lit("as of 2026-01-02 we agreed, agreed and will"), F.lit("x"))) == [1.0, 1.0, 1.0, 2 / 3, 0.0, 1.0]
    assert one(spark, N.presentation(F.lit("compare them"), F.lit(9))) == "table"
    assert one(spark, N.cheap_spans(F.lit('New York and NEW YORK, "so be it"'))) == ["New York", "NEW", "YORK", "so be it"]


def test_parsers(spark):
    md = spark.createDataFrame([(1, "intro\n# A\ntext\n## B\nmore\n### C\n\n## D\nx")], "id int, text string")
    s = P.section_parents(P.markdown_sections(md, "id", "text"), "id").orderBy("idx").collect()
    assert [(r.level, r.heading, r.parent) for r in s] == [(1, "", None), (1, "A", None), (2, "B", 1), (3, "C", 2), (2, "D", 1)]
    assert [r.content for r in P.paragraphs(spark.createDataFrame([(1, "a\n\n \n b \n\nc")], "id int, text string"), "id", "text").orderBy("idx").collect()] == ["a", "b", "c"]
    html = spark.createDataFrame([(1, "<head><title>T</title><style>x</style></head><p>pre<h2>H &amp; I</h2><p>body<script>no</script>")], "id long, html string")
    assert [(r.title, r.level, r.heading, r.content) for r in P.html_sections(html, "id", "html").orderBy("idx").collect()] == [("T", 1, "", "pre"), ("T", 2, "H & I", "body")]
    mails = spark.createDataFrame([("a", None, "2026-01-01"), ("b", "a", "2026-01-03"), ("c", "a", "2026-01-02"), ("d", "zz", "2026-01-04"), ("b", "a", "2026-01-05"), ("e", "b", "2026-01-06")], "msgid string, in_reply_to string, date string")
    t = P.mail_threads(mails.withColumn("date", F.to_timestamp("date"))).orderBy("root", "path").collect()
    assert [(r.msgid, r.root, r.depth) for r in t] == [("a", "a", 0), ("c", "a", 1), ("b", "a", 1), ("e", "a", 2), ("d", "d", 0)]
    code = spark.createDataFrame([(1, "import x\n\ndef f():\n    pass\nclass A:\n    def g(self): pass")], "id int, text string")
    assert [r.name for r in P.code_units(code, "id", "text").orderBy("idx").collect()] == ["", "f", "A"]


def test_json_lines_and_resume(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\nbroken\n{"id": 2, "t": "b"}\n')
    good, bad = P.read_json_lines(spark, str(tmp_path / "x.jsonl"), "id long, t string")
    assert good.count() == 2 and [r._corrupt for r in bad.collect()] == ["broken"]
    assert [r.id for r in sinks.remaining(good, spark.createDataFrame([(1,)], "id long"), "id").collect()] == [2]
    back = sinks.compacted(good, "id", str(tmp_path / "c"), 2)
    assert L.table_difference(good, back).count() == 0


def test_auc_and_ridge(spark):
    rng = random.Random(4)
    rows = [(1, rng.randint(0, 20), rng.randint(0, 1)) for _ in range(300)]
    wins = [(a > b) + 0.5 * (a == b) for _, a, x in rows if x for _, b, y in rows if not y]
    got = E.auc(spark.createDataFrame(rows, "k int, s int, y int"), "k", "s", "y").first()
    assert got.auc == pytest.approx(sum(wins) / len(wins))
    line = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 1) for i in range(200)], "a double, b double, y double")
    w = E.ridge(line, ["a", "b"], "y", 0.0)
    assert w[0] > 0 > w[1]


@pytest.mark.parametrize("name", ["stream_distinct_events", "stream_recurrent_state"])
def test_streams_do_not_depend_on_files(spark, tmp_path, name):
    rng, rows = random.Random(4), []
    for i in range(3000):
        user = 7 if i % 3 else rng.randrange(40)
        rows.append((i, 1_700_000_000 + i * 3600, user, f"t{i % 3}", rng.random() * 9 if i != 2501 else "NULL"))
    rng.shuffle(rows)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    con = duckdb.connect()
    for k in range(150):  # more than two batches of 64 files
        some = rows[k * 20 : k * 20 + 20] + (rows[:2] if k % 50 == 49 and "distinct" in name else [])
        values = ", ".join(f"({i}::BIGINT, make_timestamp({ts * 10**6}), {u}::BIGINT, '{kind}', {v}::DOUBLE, '')" for i, ts, u, kind, v in some)
        con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{folder}/{k:03}.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # user 7 lies in several blocks
    try:
        df = catalog.QUERIES[name](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == sorted(tuple(plain(v) for v in r) for r in want)


def test_threads_and_closures_beyond_32_levels(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        mails = [(i, i - 1 if i else None) for i in range(36)] + [(100, 101), (101, 100), (102, 101), (103, 102)]
        df = spark.createDataFrame(mails, "msgid long, in_reply_to long").withColumn("date", F.lit("2024-01-01").cast("date"))
        got = {r.msgid: (r.root, r.depth) for r in P.mail_threads(df).collect()}
        assert got == {i: (0, i) for i in range(36)} | {100: (100, 0), 101: (101, 0), 102: (101, 1), 103: (101, 2)}
        chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(36)] + [("x", "y"), ("y", "x")], "child string, parent string")
        far = {r.ancestor: r.distance for r in D.class_closure(chain).where("child IN ('c0', 'x')").collect()}
        assert far == {f"c{i}": i for i in range(1, 37)} | {"y": 1, "x": 2}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_feedback_in_runs_equals_a_walk(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randint(0, 2)}", i, rng.randint(0, 6)) for i in range(900)]
    want: dict[str, float] = {}
    for unit, _, rating in rows:
        if 1 <= rating <= 5:
            want[unit] = min(4.0, max(0.25, want.get(unit, 1.0) * (0.5 + (rating - 1) / 4)))
    for run in (1, 7, 4096):
        got = {r.unit: r.value for r in L.compounded_boost(spark.createDataFrame(rows, "unit string, position int, rating int"), run).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("run", [1, 7, 4096])
def test_retrievals_in_runs_equal_a_walk(spark, run):
    rng = random.Random(run)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(0, 40 * 86400, 1800), rng.choice([0.5, 1.0, 2.0]), i) for i in range(900)]
    rows += [("hot", 86399, 1.0, 901), ("hot", 86400, 1.0, 902), ("hot", 2 * 86400 - 1, 1.0, 903), ("once", 5, 1.0, 904), (None, 5, 1.0, 905), ("a", None, 1.0, 906)]
    want, seen = {}, defaultdict(list)
    known = sorted((r for r in rows if r[0] and r[1] is not None), key=lambda r: (r[1], r[3]))
    for edge, at, modifier, _ in known:
        recent = sum(at - 86400 < t <= at for e, t, _, _ in known if e == edge)
        rate = want.get(edge, 0.01)
        rate = min(0.05, rate * 1.02) if recent > 5 else rate * (1 - 0.05 * modifier / (1 + 0.3 * len(seen[edge])))
        want[edge] = max(0.001, rate)
        seen[edge].append(at)
    got = L.retrieval_fold(spark.createDataFrame(rows, "edge string, seconds long, modifier double, event_id long"), run=run).collect()
    assert {r.edge: r.rate for r in got} == pytest.approx(want) and {r.edge: r.n for r in got} == {e: len(t) for e, t in seen.items()}


def test_statistics_of_counted_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(25))])) for _ in range(700)] + [("none", None), ("one", 3.0)]
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(float(v))
    df = spark.createDataFrame(rows, "k string, v double")
    stats = {r.k: r for r in E.upper_stats(df, "k", "v").collect()}
    shares = {r.k: r for r in E.quantiles(df, "k", "v", {"low": 0.1, "mid": 0.5}).collect()}
    assert set(stats) == set(shares) == set(by)
    for k, v in by.items():
        v.sort()
        n = len(v)
        assert (stats[k].n, stats[k].least, stats[k].most) == (n, v[0], v[-1])
        assert (stats[k].upper_median, stats[k].p99) == (v[n // 2], v[min(n - 1, math.ceil(n * 0.99) - 1)])
        assert stats[k].mean == pytest.approx(sum(v) / n)
        for name, q in (("low", 0.1), ("mid", 0.5)):
            at = q * (n - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert shares[k][name] == pytest.approx(low + (high - low) * (at - math.floor(at)))
    assert E.quantiles(df.limit(0), "k", "v", {"mid": 0.5}).count() == 0


def test_pairs_without_an_edge_against_all_pairs(spark):
    rng = random.Random(7)
    nodes = [(c, f"n{i:02d}", rng.choice("xy")) for c in ("c", "d") for i in range(14)]
    edges = [(f"n{rng.randint(0, 13):02d}", "p", f"n{rng.randint(0, 13):02d}") for _ in range(60)] + [("n00", "p", f"n{i:02d}") for i in range(14)]
    linked = {frozenset((a, b)) for a, _, b in edges}
    for most in (1, 4, 500):
        want = set()
        for c in ("c", "d"):
            kind = {n: k for x, n, k in nodes if x == c}
            free = sorted((a, b) for a in kind for b in kind if a < b and kind[a] == kind[b] and frozenset((a, b)) not in linked)
            want |= {(c, *p) for p in free[:most]}
        got = D.nonadjacent_pairs(spark.createDataFrame(nodes, "center string, node string, kind string"), spark.createDataFrame(edges, "s string, p string, o string"), most)
        assert {tuple(r) for r in got.collect()} == want
