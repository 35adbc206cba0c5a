"""Freshness in a stream against a plain walk, for any cut into batches and after a restart."""

import random
from collections import defaultdict

import pytest

from memlattice.streaming import freshness as Z
from memlattice.streaming import pipelines as P


def walked(rows, ring, lag, first=0):
    """Signals by session, turn after turn, as a list kept in memory would give them."""
    out, by_session = [], defaultdict(dict)
    for session, turn, sources, hits in rows:
        if session is not None and turn is not None:
            by_session[session].setdefault(turn, (sources or [], hits or []))
    for session, turns in by_session.items():
        slots, entry, number, t = [], {}, 0, first
        while t in turns:
            seen = set()
            for source, n in zip(*turns[t], strict=True):
                if source is None or source in seen:
                    continue
                seen.add(source)
                entry.setdefault(source, t)
                age = t - entry[source]
                slots.append(source)
                out.append((session, t, source, "recall" if n else "stale_uncertain" if age < lag else "dropped", age, number))
                number += 1
            live = set(slots[-ring:])
            entry = {s: e for s, e in entry.items() if s in live}
            t += 1
    return sorted(out)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    rows = [(f"s{k}", t, [rng.choice("abcdefg") for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]) for k in range(5) for t in range(20) for n in [rng.randint(0, 4)]]
    rows += [("gap", t, ["x"], [0]) for t in (0, 1, 3)] + [(None, 0, ["x"], [0]), ("s0", None, ["x"], [1]), ("null", 0, None, None), ("null", 1, ["a", None], [0, 1])]
    rng.shuffle(rows)
    return rows


def run(spark, folder, ring, lag, capacity, per_trigger):
    stream = P.event_stream(spark, f"{folder}/in", Z.TURNS, per_trigger)
    signals = Z.freshness_signals(stream, ring, lag, capacity)
    signals.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


@pytest.mark.parametrize("files", [1, 7])
def test_signals_and_buffers_do_not_depend_on_batches(spark, tmp_path, turns, files):
    Z.with_state_store(spark)
    cut = len(turns) * 2 // 3
    spark.createDataFrame(turns[:cut], Z.TURNS).repartition(files).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, 4, 3, 6, 3)
    again = turns[cut:] + turns[:9]  # what comes a second time changes nothing
    spark.createDataFrame(again, Z.TURNS).repartition(files).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, 4, 3, 6, 3)  # the stream starts again from its checkpoint
    want = walked(turns, 4, 3)
    assert got == want and {k for _, _, _, k, _, _ in got} == {"recall", "stale_uncertain", "dropped"}
    newest = {s: max(n for x, *_, n in want if x == s) for s, *_ in want}
    held = sorted((r.session, r.turn, r.source, r.kind, r.age, r.number) for r in Z.buffered_signals(spark, f"{tmp_path}/checkpoint").collect())
    assert held == [w for w in want if w[5] > newest[w[0]] - 6]
    assert [w[1] for w in got if w[0] == "gap"] == [0, 1]  # turn 3 waits for turn 2
