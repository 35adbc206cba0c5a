"""Rings as of a turn, traces and losses against plain code."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from memlattice.operators import losses as L
from memlattice.operators import ring as R


@pytest.fixture(scope="module")
def touches():
    rng = random.Random(1)
    rows = [(f"s{k}", t, p, rng.choice("abcdefgh"), rng.choice([None, 0.1, 0.5, 0.9])) for k in range(4) for t in range(15) for p in range(rng.randint(0, 5))]
    return rows + [(None, 0, 0, "x", 1.0), ("s0", None, 0, "x", 1.0), ("s0", 1, 0, None, 1.0)]


def rings(touches, turns, ring):
    out = {}
    real = [r for r in touches if None not in r[:4]]
    for s, t in turns:
        slots = [(r[3], r[4]) for r in sorted(r for r in real if r[0] == s and r[1] < t)]
        out[s, t] = list(enumerate(slots))[-ring:]
    return out


@pytest.mark.parametrize("ring", [1, 3, 8, 100])
def test_ring_traces_and_contexts(spark, touches, ring):
    rng = random.Random(2)
    turns = [(f"s{k}", t) for k in range(5) for t in range(0, 17, 2)]
    df = spark.createDataFrame(touches, "session string, turn long, pos long, source string, score double")
    held = R.ring_at(df, spark.createDataFrame([*turns, turns[0], (None, 1)], "session string, turn long"), ring)
    got = defaultdict(list)
    for r in held.collect():
        got[r.session, r.turn].append((r.slot, (r.source, r.score)))
    want = rings(touches, turns, ring)
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    records = {(r.session, r.turn): (r.sources, r.scores, r.gold) for r in R.trace_records(held).collect()}
    for key, slots in want.items():
        kept = [x for _, x in slots if x[1] is not None]
        if len(kept) >= 3:
            scores = [x[1] for x in kept]
            assert records.pop(key) == ([x[0] for x in kept], scores, scores.index(max(scores)))
    assert not records
    retrieved = [(s, t, i, rng.choice("abcdefghxyz")) for s, t in turns for i in range(rng.randint(0, 6))]
    plan = defaultdict(list)
    for r in R.planned_context(held, spark.createDataFrame(retrieved, "session string, turn long, rank long, unit string"), 2).orderBy("place").collect():
        plan[r.session, r.turn].append((r.unit, r.primary, r.strategy))
    for key in turns:
        units = list(dict.fromkeys(u for s, t, _, u in sorted(retrieved) if (s, t) == key))
        best = {}
        for slot, (source, score) in want[key]:
            best[source] = max(best.get(source, (-1.0, -1)), (-1.0 if score is None else score, slot))
        chosen = sorted((u for u in units if u in best), key=lambda u: (-best[u][0], -best[u][1]))[:2]
        strategy = None if not chosen else "direct" if len(chosen) == len(units) else "chunked"
        assert plan[key] == [(u, u in chosen, strategy) for u in chosen + [u for u in units if u not in chosen]]


def lse(x):
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    spread = {"flat": (0, 1, 40), "high": (1000, 5, 40), "low": (-1000, 5, 40), "wide": (0, 1000, 60), "one": (3, 1, 1), "long": (0, 30, 3000)}
    return {k: [rng.gauss(mean, sd) for _ in range(n)] for k, (mean, sd, n) in spread.items()}


def test_stable_sums_and_lists(spark, lists):
    rng = random.Random(4)
    gold = {k: [rng.random() < 0.3 and k != "one" for _ in v] for k, v in lists.items()}
    rows = [(k, i, s, g) for k, v in lists.items() for i, (s, g) in enumerate(zip(v, gold[k], strict=True))]
    df = spark.createDataFrame([*rows, ("flat", None, None, True), (None, 0, 1.0, True)], "list string, place long, score double, gold boolean").repartition(5)
    sums = {r.list: (r.lse, r.n) for r in L.list_lse(df, "list", "score").collect()}
    assert sums.keys() == lists.keys()
    for k, v in lists.items():
        assert sums[k] == (pytest.approx(lse(v), rel=1e-12, abs=1e-9), len(v))
    got = {r.list: r.loss for r in L.listwise(df).collect() if r.list}
    for k, v in lists.items():
        own = [s for s, g in zip(v, gold[k], strict=True) if g]
        assert got[k] == pytest.approx(lse(v) - sum(own) / len(own) if own else 0.0, rel=1e-9, abs=1e-9)


def test_plackett_luce_over_blocks(spark, lists):
    rows = [(k, i, s) for k, v in lists.items() for i, s in enumerate(v)]
    df = spark.createDataFrame([*rows, ("flat", None, 1.0), ("flat", 0, -1e9)], "list string, place long, score double").repartition(4)
    got = {r.list: (r.n, r.loss) for r in L.plackett_luce(df).collect()}
    for k, v in lists.items():
        tail, want = -math.inf, 0.0
        for s in reversed(v):
            tail = np.logaddexp(tail, s)
            want += tail - s
        assert got[k] == (len(v), pytest.approx(want, rel=1e-9, abs=1e-7))


def test_cross_entropy_and_the_price_of_a_confusion(spark):
    logits = {0: [2.0, 1.0, -1.0], 1: [0.0, 1000.0, 999.0], 2: [5.0, 5.0, 5.0]}
    truth = {0: 0, 1: 1, 2: 2}
    a = spark.createDataFrame([(i, c, x) for i, v in logits.items() for c, x in enumerate(v)], "item long, class long, logit double")
    b = spark.createDataFrame([*truth.items(), (9, 0)], "item long, class long")
    got = {r.item: r.loss for r in L.cross_entropy(a, b, {0: 2.0}, (1, 2), 3.0).collect()}
    for i, v in logits.items():
        want = (2.0 if truth[i] == 0 else 1.0) * (lse(v) - v[truth[i]]) + (3.0 * math.exp(v[2] - lse(v)) if truth[i] == 1 else 0.0)
        assert got[i] == pytest.approx(want)
    assert len(got) == 3
    plain = {r.item: r.loss for r in L.cross_entropy(a, b, {}).collect()}
    assert plain[0] == pytest.approx(lse(logits[0]) - 2.0)


def test_contrast_and_margin(spark):
    rng = np.random.default_rng(5)
    rows = [(b, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for b in (1, 2) for _ in range(6)] + [(3, [0.0] * 4, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4, [1.0] * 4), (1, None, [1.0] * 4)], "batch long, anchor array<double>, positive array<double>")
    got = {r.batch: (r.n, r.loss) for r in L.in_batch_contrast(df, 0.5).collect()}
    for b in (1, 2):
        x, y = (np.array([r[k] for r in rows if r[0] == b]) for k in (1, 2))
        like = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T / 0.5
        assert got[b] == (6, pytest.approx(np.mean([lse(like[i]) - like[i, i] for i in range(6)])))
    assert got[3] == (1, pytest.approx(0.0)) and len(got) == 3
    m = L.margin_ranking(spark.createDataFrame([(1.0, 0.5), (0.5, 0.5), (2.0, 0.0), (None, 1.0)], "better double, worse double"), 0.6).first()
    assert (m.n, m.broken, m.loss) == (3, 2, pytest.approx((0.1 + 0.6) / 3))
