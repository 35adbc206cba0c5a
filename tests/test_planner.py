"""The planner on small prompts and against a plain longest match."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from memlattice.operators import planner as P

DICTIONARY = [("graph", "topic", "graph"), ("Graph database", "topic", "gdb"), ("database design of graphs", "topic", "design"), ("database", "topic", "db"), ("angry", "tone", "angry"), ("both", "joint", "x"), (None, "topic", "n"), ("", "topic", "e")]


def plan(spark, texts, year=2026):
    prompts = spark.createDataFrame(list(enumerate(texts)) + [(None, "Bob")], "id long, text string")
    entries = spark.createDataFrame(DICTIONARY, "phrase string, kind string, label string")
    stop = spark.createDataFrame([("what",), ("DID",), (None,)], "word string")
    return {r.id: r for r in P.planned(prompts, entries, stop, year).collect()}


def test_plans(spark):
    got = plan(spark, ["What did Alice and Bob both say, angry, on the graph-database?", "database design of graphs, a graph and Alice", None, "", "in June 2025 last week", "between March 2024 and May", "between may and june 2023", "within june"])
    a, b = got[0], got[1]
    assert (a.entities, a.topics, a.tones, a.entity_mode) == (["Alice", "Bob"], ["gdb"], ["angry"], "intersection")
    assert (b.entities, b.topics, b.tones, b.entity_mode) == (["Alice"], ["design", "graph"], [], "union")
    assert len(got) == 8 and got[2].entities == [] == got[3].topics and got[2].date_from is None
    day = dt.date
    assert (got[4].date_from, got[4].date_to, got[4].bucket) == (day(2025, 6, 1), day(2025, 6, 30), "last_week")
    assert (got[5].date_from, got[5].date_to) == (day(2024, 3, 1), day(2024, 5, 31))
    assert (got[6].date_from, got[6].date_to) == (day(2023, 5, 1), day(2023, 6, 30))
    assert got[7].date_from is None


def test_longest_matches_against_a_scan(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d"]
    phrases = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    texts = ["".join(rng.choice([*words, "zz"]) + rng.choice([" ", ", ", " - "]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    entries = spark.createDataFrame([(p, "k", p) for p in phrases], "phrase string, kind string, label string")
    got = {}
    for r in P.phrase_matches(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), entries).collect():
        got.setdefault(r.id, set()).add((r.start, r.size, r.label))
    for i, t in enumerate(texts):
        ws = re.findall("[a-z0-9_]+", t)
        every = [(s, n, " ".join(ws[s : s + n])) for n in range(1, 5) for s in range(len(ws) - n + 1) if " ".join(ws[s : s + n]) in phrases]
        want = {m for m in every if not any(o != m and o[0] <= m[0] and o[0] + o[1] >= m[0] + m[1] for o in every)}
        assert got.get(i, set()) == want
    assert P.phrase_matches(spark.createDataFrame([(1, "a")], "id long, text string"), entries.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,whole,parts",
    [("```json\n{\"a\": {\"b\": 1}}\n``` done", '{"a": {"b": 1}}', ['{"b": 1}']), ('x [{"a": 1}, {"b": 2}, {"c', '{"a": 1}, {"b": 2}', ['{"a": 1}', '{"b": 2}']), ("none", None, []), (None, None, None)],
)
def test_answers(spark, text, whole, parts):
    r = spark.createDataFrame([(text,)], "t string").select(P.outer_object(F.col("t")).alias("o"), P.complete_objects(F.col("t")).alias("p")).first()
    assert (r.o, r.p) == (whole, parts)
