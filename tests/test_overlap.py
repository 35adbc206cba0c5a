"""Pairs of sets with much in common, against every pair."""

import random
from itertools import combinations

import pytest

from memlattice.operators import overlap as V


def sets_of(rng, n):
    items = [f"w{i}" for i in range(40)] + [f"r{i}" for i in range(900)]
    some = {f"e{i:04d}": rng.sample(items[:40], rng.randint(0, 8)) + rng.sample(items[40:], rng.randint(0, 5)) for i in range(n)}
    return some | {f"f{i:04d}": list(some[f"e{i:04d}"]) + ["more"] for i in range(0, n, 9)} | {f"g{i}": ["one", "two", "three", "four", "five"] for i in range(12)}


@pytest.mark.parametrize("least, ratio", [(4, 0.0), (1, 0.3), (1, 1.0), (3, 0.5)])
def test_pairs_against_every_pair(spark, monkeypatch, least, ratio):
    monkeypatch.setattr(V, "BLOCK_ROWS", 70)
    monkeypatch.setattr(V, "OWN", 8)
    monkeypatch.setattr(V, "COLUMNS", 16)
    monkeypatch.setattr(V, "TILE", (9, 31))
    monkeypatch.setattr(V, "PAIRS", 50)
    sets = sets_of(random.Random(8), 200)
    df = spark.createDataFrame([*sets.items(), ("empty", []), ("none", None), (None, ["one", "two"])], "id string, items array<string>")
    want = set()
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        common = len(set(x) & set(y))
        if common >= max(least, 1) and common >= ratio * (len(x) + len(y) - common):
            want.add((a, b, common, len(x), len(y)))
    got = [tuple(r) for r in V.overlapping_pairs(df, least, ratio).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert V.overlapping_pairs(df.limit(0), least, ratio).count() == 0


def test_similar_episodes_writes_no_candidates(spark, small):
    """The plan meets blocks of sets; candidates are not joined, told apart and joined again."""
    from memlattice.plans.consolidation import similar_episodes
    from memlattice.plans.retrieval import related_by_topic

    for query in (similar_episodes, related_by_topic):
        plan = query(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
