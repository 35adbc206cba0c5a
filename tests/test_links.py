"""Citations, sampled negatives and asserted states against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memlattice.sources import tables as T
from memlattice.functions import language as N
from memlattice.operators import citations as I
from memlattice.operators import memory as M


def cite(spark, texts, titles):
    a = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(titles)), "doc long, title string")
    return {tuple(r) for r in I.cited_documents(a, b).collect()}


def test_short_quoted_and_inner_titles(spark):
    texts = ["see the Blue Book for details", 'about "the quick brown fox" here', "the quick brown fox, again", "unthinkable", None, "", "nothing"]
    titles = ["Blue Book", "the quick brown fox", "quick brown fox", "think", None, "", "fox", "  nothing! "]
    assert cite(spark, texts, titles) == {(0, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (6, 7)}


def test_citations_against_every_pair(spark):
    rng = random.Random(12)
    words = ["ab", "abc", "bca", "Cab", "äö", "日本", "x", "longer-word", "a_b"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "", "\n"]) for _ in range(n))
    texts = [say(rng.randint(0, 60)) for _ in range(80)] + [say(4000) + "the needle" + say(10), say(30)]
    titles = [say(rng.randint(1, 30)) for _ in range(60)] + [t[3 : 3 + rng.choice([4, 9, 20, 40, 90])] for t in texts[:40]] + ["the needle", texts[-1]] * 2
    normal = lambda t: re.sub(r"\s+", " ", t.lower())
    named = [re.sub(r"^[ .,;:!?\"'()\[\]-]+|[ .,;:!?\"'()\[\]-]+$", "", normal(t)) for t in titles]
    want = {(i, j) for i, t in enumerate(texts) for j, n in enumerate(named) if len(n) >= 4 and n in normal(t)}
    assert cite(spark, texts, titles) == want and len(want) > 100


def test_a_full_table_of_bits_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(I, "LEAST_BITS", 1 << 16)
    titles = [f"title number {i:05d}" for i in range(3000)]
    texts = [f"see {t} and more" for t in titles[::7]]
    monkeypatch.setattr(I, "MOST_BITS", 64)
    got = cite(spark, texts, titles)
    assert {(7 * i) for i, _ in got} == {j for _, j in got} and len(got) == len(texts)


def test_windows_end_inside_a_text_and_long_texts_are_cut(spark):
    text = "z" * (1 << 20) + "the exact passage that crosses the cut of a stretch" + "y" * 70
    cut = "z" * ((1 << 20) - 20) + "the exact passage that crosses the cut of a stretch"
    assert cite(spark, [text, cut, ""], ["the exact passage that crosses the cut of a stretch", "zzzzy"]) == {(0, 0), (1, 0)}
    assert cite(spark, [], ["title"]) == set() == cite(spark, ["title"], [])


def test_few_windows_pass_that_no_title_begins_with(spark):
    """What the table of bits lets through is joined and shuffled: with many titles it stays near what they have."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    titles = spark.createDataFrame([(i, word()) for i in range(20_000)], "doc long, title string")
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(40))) for i in range(20)], "id long, text string")
    passed = []
    real = I._text_keys

    def counted(table, sizes):
        run = real(table, sizes)
        passed.append(sum(b.num_rows for b in run(iter(texts.toArrow().to_batches()))))
        return run

    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "_text_keys", counted)
        assert I.cited_documents(texts, titles).count() == 0
    assert passed[0] < 20 * 400 * 0.06  # 8 bits a title: about one in six


def test_every_node_gets_its_negatives(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(1000)] + [(None,), ("n1",)], "node string")
    none = spark.createDataFrame([], "a string, b string")
    got = M.negative_pairs(none, nodes, 3, 5).collect()
    assert len(got) == 3000 and len({tuple(r) for r in got}) == 3000 and all(r.a != r.b for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.negative_pairs(none, nodes.repartition(7), 3, 5).collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, M.negative_pairs(none, nodes, 3, 6).collect()))


def test_negatives_leave_out_positives_both_ways_and_exhaust(spark):
    names = [f"n{i}" for i in range(12)]
    positives = [("n0", n) for n in names[1:11]] + [("n5", "n6"), ("n6", "n5"), ("n3", None)]
    rows = M.negative_pairs(spark.createDataFrame(positives, "a string, b string"), spark.createDataFrame([(n,) for n in names], "node string"), 4, 1).collect()
    linked = {frozenset(p) for p in positives}
    by = {n: {r.b for r in rows if r.a == n} for n in names}
    assert by["n0"] == {"n11"} and all(len(by[n]) == 4 for n in names[1:]) and all(frozenset((r.a, r.b)) not in linked for r in rows)
    kinds = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "l"), ("d", "l"), ("e", "m")], "node string, kind string")
    assert {tuple(r) for r in M.negative_pairs(spark.createDataFrame([], "a string, b string"), kinds, 3, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


STATES = {
    "The owner: Alice.": ("owner", "Alice"),
    "database = Postgres": ("database", "Postgres"),
    "the deployment target is now production": ("deployment target", "production"),
    "Budget was 5 million;": ("budget", "5 million"),
    "plan changed to B": ("plan", "B"),
    "our team became larger, and better.": ("team", "larger, and better"),
    "the team moved to Berlin": ("team", "Berlin"),
    "he said (yes): fine": None,  # a key has words only
    "one two three four five six seven: x": None,
    "1st place: Bob": None,
    "key:": None,
    ": value": None,
    "is it so": None,
    "": None,
    "x" * 62 + ": v": None,
    "k: " + "v" * 121: None,
    "k: " + "v" * 120: ("k", "v" * 120),
    "nothing here": None,
    "a: b": ("a", "b"),
    "rate (per day) is 5": None,
    "state: is now open": ("state", "is now open"),
    "(a=b) the door is shut": None,
}


def test_asserted_states(spark):
    rows = spark.createDataFrame([(k,) for k in [*STATES, None]], "line string")
    got = {r.line: r.a and tuple(r.a) for r in rows.select("line", N.assertion(F.col("line")).alias("a")).collect()}
    assert got == {**STATES, None: None}


@pytest.mark.parametrize("line,want", [("a=b:c", ("a", "b:c")), ("owner is: Al", ("owner is", "Al")), ("plain", None)])
def test_fields(spark, line, want):
    got = spark.range(1).select(N.field(F.lit(line)).alias("a")).first().a
    assert (got and tuple(got)) == want


def test_what_one_task_sends_is_written_by_several(spark, small, monkeypatch):
    monkeypatch.setattr(T, "WRITE_BYTES", "64k")
    rows = spark.range(0, 300000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("s"), F.lit("child_of").alias("p"))
    found = T.stored(spark, small, "one_sender", ["conversations"], lambda: rows, "p")
    assert len(found.inputFiles()) > 1
    assert found.agg(F.count("s"), F.countDistinct("s")).first() == (300000, 300000)
    assert found.columns == ["s", "p"]
