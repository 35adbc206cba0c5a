"""Turn-based freshness of sources in a stream, with bounded state per session.

A session's turns name the sources they touch and how many units were found for each.  Per
session the state keeps, for every source in the ring of the last `ring` touches, the turn in which
it entered; a source that has left the ring enters anew.  At each turn a source gives a signal:

* recall: something was found for it;
* stale_uncertain: nothing was found and it entered fewer than `lag` turns ago;
* dropped: nothing was found and it had its chance.

Signals are also kept in a buffer of the last `capacity` per session, a map by signal number
modulo the capacity, so a new signal replaces the oldest in one step.

Turns are taken in order of their numbers, whatever the order and the batches in which they come: one
that comes early waits in the state until those before it are there, and one that comes
again is ignored.  Nothing that is kept grows with a session's length but turns that wait for a missing one.

Defined results: rows without session or turn are left out; a turn without sources only
counts as a turn; a null source is left out; a source that a turn names twice counts at its first place;
turns begin at `first`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stream has: one row per turn.
TURNS = "session string, turn long, sources array<string>, hits array<long>"
SIGNALS = "session string, turn long, source string, kind string, age long, number long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Workers get the processor itself, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Freshness(StatefulProcessor):
    """State per session: a clock, turns that wait, the ring's sources and the buffer."""

    def __init__(self, ring: int, lag: int, capacity: int, first: int):
        self.ring, self.lag, self.capacity, self.first = ring, lag, capacity, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "turn long, slots long, signals long")
        self.waiting = handle.getMapState("waiting", "turn long", "sources array<string>, hits array<long>")
        self.entered = handle.getMapState("entered", "source string", "turn long, slot long")
        self.buffer = handle.getMapState("buffer", "place long", "number long, turn long, source string, kind string, age long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, slots, signals = self.clock.get() if self.clock.exists() else (self.first, 0, 0)
        new = {}
        for frame in rows:
            for t, sources, hits in zip(frame["turn"], frame["sources"], frame["hits"], strict=True):
                if t >= turn and t not in new and not self.waiting.containsKey((int(t),)):
                    new[int(t)] = (list(sources) if sources is not None else [], list(hits) if hits is not None else [])
        kept = {source: (begun, slot) for (source,), (begun, slot) in self.entered.iterator()}
        before, out = dict(kept), []
        while turn in new or self.waiting.containsKey((turn,)):
            if turn in new:
                sources, hits = new.pop(turn)
            else:
                sources, hits = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            found = {}
            for source, n in zip(sources, hits, strict=True):
                if source is not None and source not in found:
                    found[source] = n
            for source, n in found.items():
                begun = kept[source][0] if source in kept else turn
                age = turn - begun
                kept[source] = (begun, slots)
                slots += 1
                kind = "recall" if n and n > 0 else "stale_uncertain" if age < self.lag else "dropped"
                out.append((key[0], turn, source, kind, age, signals))
                signals += 1
            kept = {s: x for s, x in kept.items() if x[1] >= slots - self.ring}
            turn += 1
        for t, (sources, hits) in new.items():
            self.waiting.updateValue((t,), (sources, hits))
        for source in before.keys() - kept.keys():
            self.entered.removeKey((source,))
        for source, value in kept.items():
            if before.get(source) != value:
                self.entered.updateValue((source,), value)
        for _, t, source, kind, age, number in out[-self.capacity :]:
            self.buffer.updateValue((number % self.capacity,), (number, t, source, kind, age))
        self.clock.update((turn, slots, signals))
        yield pd.DataFrame(out, columns=["session", "turn", "source", "kind", "age", "number"])

    def close(self) -> None:
        pass


def freshness_signals(turns: DataFrame, ring: int = 8, lag: int = 3, capacity: int = 1000, first: int = 0) -> DataFrame:
    """The signals of a stream of turns (TURNS), in append mode; the session must use the RocksDB state store."""
    known = turns.where("session IS NOT NULL AND turn IS NOT NULL")
    return known.groupBy("session").transformWithStateInPandas(Freshness(ring, lag, capacity, first), SIGNALS, "Append", "None")


def with_state_store(spark: SparkSession) -> None:
    """Name the state store that keyed state needs, where the session names another; batches then store changes, not whole tables.

    The store reserves megabytes of disk for the log files of each partition unless told not to, however little a partition holds.
    """
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def buffered_signals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, number, turn, source, kind, age): what the buffers hold, read from a stream's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "buffer").load()
    return state.select("key.session", *[f"user_map_value.{c}" for c in ("number", "turn", "source", "kind", "age")])
