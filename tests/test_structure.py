"""Outlines and chains against plain walks."""

import random

import pytest

from memlattice.operators import chains as C
from memlattice.operators import classes as K
from memlattice.operators import outline as O


def merged_plain(sections, least):
    """[(idx, level, parent, content, merged)] of one document's (idx, level, content), by a list and a stack."""

    def parents(rows):
        out, open_ = [], []
        for idx, level, *_ in rows:
            while open_ and open_[-1][1] >= level:
                open_.pop()
            out.append(open_[-1][0] if open_ else None)
            open_.append((idx, level))
        return out

    rows = sorted(sections)
    up = dict(zip([r[0] for r in rows], parents(rows), strict=True))
    body, count, gone = {r[0]: r[2] or "" for r in rows}, {r[0]: 0 for r in rows}, set()
    for idx, _, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        p = up[idx]
        if max(1, len(body[idx]) // 4) < least and p is not None:
            body[p] = "\n\n".join(x for x in (body[p], body[idx]) if x)
            count[p] += count[idx] + 1
            gone.add(idx)
    left = [r for r in rows if r[0] not in gone]
    return [(r[0], r[1], p, body[r[0]], count[r[0]]) for r, p in zip(left, parents(left), strict=True)]


def test_contraction_against_a_walk(spark):
    rng = random.Random(8)
    docs = {f"d{k}": [(i, rng.choice([1, 2, 2, 3, 4, 6]), rng.choice(["", "x" * rng.randint(1, 30), "y" * rng.randint(30, 90)])) for i in range(rng.randint(1, 30))] for k in range(40)}
    rows = [(d, *s, 1) for d, ss in docs.items() for s in ss] + [("d0", None, 1, "lost", 1), (None, 1, 1, "lost", 1), ("d1", 5000, None, "lost", 1)]
    rng.shuffle(rows)
    got = O.contracted(spark.createDataFrame(rows, "doc string, idx long, level int, content string, tokens int"), "doc", least=12).collect()
    for d, ss in docs.items():
        mine = sorted((r.idx, r.level, r.parent, r.content, r.merged) for r in got if r.doc == d)
        assert mine == merged_plain(ss, 12)
        assert all(r.tokens == max(1, len(r.content) // 4) for r in got if r.doc == d)


def test_contraction_of_deep_empty_and_null(spark):
    deep = [("a", i, i + 1, f"s{i}") for i in range(12)]  # everything falls into the first
    rows = [*deep, ("b", 0, 2, None), ("b", 1, 2, None), ("c", 0, 1, "x" * 400), ("c", 1, 2, None), ("c", 1, 2, None)]
    df = spark.createDataFrame(rows, "doc string, idx long, level int, content string")
    got = {(r.doc, r.idx): r for r in O.contracted(df, "doc").collect()}
    assert sorted(got) == [("a", 0), ("b", 0), ("b", 1), ("c", 0)]
    assert got["a", 0].content == "\n\n".join(f"s{i}" for i in range(12)) and got["a", 0].merged == 11
    assert got["c", 0].content == "x" * 400 and got["c", 0].merged == 1
    assert O.contracted(df.limit(0), "doc").count() == 0


def plain_chains(links):
    """{node: (chain, position, length, cyclic)} by walking."""
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    nxt = {}
    for a, b in real:
        nxt[a] = min(b, nxt.get(a, b))
    claim = {}
    for a, b in nxt.items():
        claim[b] = min(a, claim.get(b, a))
    nxt = {a: b for b, a in claim.items()}
    nodes, out = {x for p in real for x in p}, {}
    for head in sorted(n for n in nodes if n not in claim):
        path = [head]
        while path[-1] in nxt:
            path.append(nxt[path[-1]])
        out |= {n: (head, i, len(path), False) for i, n in enumerate(path)}
    for head in sorted(nodes):
        if head not in out:
            path = [head]
            while nxt[path[-1]] != head:
                path.append(nxt[path[-1]])
            out |= {n: (head, i, len(path), True) for i, n in enumerate(path)}
    return out


@pytest.fixture(scope="module")
def links():
    rng = random.Random(4)
    line = lambda name, n: [(f"{name}{i:03d}", f"{name}{i + 1:03d}") for i in range(n - 1)]
    ring = lambda name, n: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    rows = line("a", 100) + line("b", 2) + ring("c", 7) + ring("d", 2) + [("e", "c3"), ("x", "x"), (None, "a000"), ("b001", None), ("a000", "a001")]
    rows += [(f"r{rng.randint(0, 40):02d}", f"r{rng.randint(0, 40):02d}") for _ in range(45)]
    rng.shuffle(rows)
    return rows


def test_ranked_chains(spark, links):
    df = spark.createDataFrame(links, "node string, next string")
    got = {r.node: (r.chain, r.position, r.length, r.cyclic) for r in C.ranked_chains(df).collect()}
    assert got == plain_chains(links) and got["a099"] == ("a000", 99, 100, False) and got["c3"][3]
    cut = C.ranked_chains(df, limit=64).where("chain = 'a000'").collect()
    assert sorted(r.position for r in cut) == list(range(64)) and {r.length for r in cut} == {64}
    assert C.ranked_chains(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 5, 64])
def test_walked_chains(spark, links, limit):
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    nxt = {a: min(b for x, b in real if x == a) for a, _ in real}
    want = set()
    for start in {a for a, _ in real} - {b for _, b in real}:
        path = [start]
        while len(path) < limit and nxt.get(path[-1]) is not None and nxt[path[-1]] not in path:
            path.append(nxt[path[-1]])
        if len(path) >= 2:
            want |= {(start, i, n, len(path)) for i, n in enumerate(path)}
    got = C.walked_chains(spark.createDataFrame(links, "node string, next string"), limit)
    assert {tuple(r) for r in got.collect()} == want


def test_sequences_need_every_position(spark):
    rows = [("a", i, "forward", f"s{i}", f"s{i + 1}") for i in range(3)] + [("a", 0, "reverse", "s1", "s0")]
    rows += [("b", 1, "forward", "p", "q"), ("c", 0, "forward", "p", "q"), ("c", 2, "forward", "r", "s"), (None, 0, "forward", "x", "y"), ("a", 1, "forward", "s1", "s2")]
    got = C.chain_sequences(spark.createDataFrame(rows, "chain string, position long, type string, state string, next_state string"))
    assert [(r.chain, r.sequence) for r in got.collect()] == [("a", ["s0", "s1", "s2", "s3"])]


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_classes_in_blocks(spark, block_rows):
    rng = random.Random(6)
    vec = lambda: [round(rng.gauss(0, 1), 1) for _ in range(3)]
    entities, classes = [(i, vec()) for i in range(40)], [(f"c{i:02d}", vec()) for i in range(25)]
    e = spark.createDataFrame([*entities, (None, vec()), (99, None), (98, [1.0])], "entity long, vector array<double>")
    c = spark.createDataFrame([*classes, (None, vec())], "class string, vector array<double>")
    got = {(r.entity, r["rank"]): (r["class"], r.score) for r in K.nearest_classes(e, c, 4, block_rows).collect()}
    assert len(got) == 160
    for i, v in entities:
        scores = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 6), name) for name, w in classes)
        assert [got[i, r + 1][0] for r in range(4)] == [name for _, name in scores[:4]]
    assert K.nearest_classes(e, c.limit(0), 4).count() == 0 and K.nearest_classes(e.limit(0), c, 4).count() == 0


def test_a_slice_goes_on_where_the_last_run_ended(spark, tmp_path):
    classes = spark.createDataFrame([(f"c{i:02d}",) for i in range(10)] + [(None,), ("c03",)], "class string")
    folder = f"{tmp_path}/state"
    take = lambda df=classes: sorted(r["class"] for r in K.next_slice(df, 4, folder).collect())
    runs = [take(), take(), take()]
    assert runs == [["c00", "c01", "c02", "c03"], ["c04", "c05", "c06", "c07"], ["c00", "c01", "c08", "c09"]]
    assert take(classes.where("class <> 'c02'")) == ["c03", "c04", "c05", "c06"]
    assert take(classes.limit(0)) == [] and take() == ["c00", "c07", "c08", "c09"]
    assert sorted(r["class"] for r in K.next_slice(classes.limit(2), 4, f"{tmp_path}/other").collect()) == ["c00", "c01"]
