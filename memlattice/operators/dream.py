"""One consolidation pass: decisions of several detectors, one per edge, applied to all tables as a new version."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.operators.graph import union_all
from memlattice.sources.sinks import materialised

#: Actions in the order in which they are decided: of several for one edge the first is taken.
ACTIONS = ("supersede", "remove", "prune", "archive", "decay", "propose")


class Memory(NamedTuple):
    """The tables of a pass.

    edges (s, p, o); sidecar (s, p, o, state, strength, seen, until): an edge without a row is current, of strength 1 and
    never seen; salience (node, score); archive (s, p, o, reason).
    """

    edges: DataFrame
    sidecar: DataFrame
    salience: DataFrame
    archive: DataFrame


class Rules(NamedTuple):
    """When which edges are decided on.

    associations: predicates that decay and are pruned; half_life and deep_after in days; an edge whose strength falls
    below `faded` is archived, one whose ends are both scored below `dull` is pruned, a candidate scored `sure` or more is proposed.
    """

    associations: tuple[str, ...]
    half_life: float = 30.0
    faded: float = 0.05
    dull: float = 0.15
    deep_after: int = 365
    sure: float = 0.85


def _days(now: Column, then: Column) -> Column:
    return (F.unix_seconds(now) - F.unix_seconds(then)) / F.lit(86400.0)


def decisions(memory: Memory, candidates: DataFrame, rules: Rules, now: Column) -> DataFrame:
    """(s, p, o, action, strength): what a pass would do, one action per edge; nothing is changed.

    * supersede: of several current states of a node all but the one seen last (ties: the greatest value);
    * remove: an edge whose archiving lies `deep_after` days back;
    * prune: an association with both ends scored and below `dull`;
    * archive: a current association whose strength falls below `faded`; decay: one whose strength falls otherwise;
    * propose: a candidate (s, p, o, score) that is no edge.

    Strength halves with every half-life since it was last seen or decayed, so a second pass at the same time
    finds nothing to do.  Null ends are left out.
    """
    side = memory.sidecar.groupBy("s", "p", "o").agg(F.max(F.struct("seen", "state", "strength", "until")).alias("_m"))  # repeated rows: the last seen
    whole = memory.edges.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("s", "p", "o").distinct().join(side, ["s", "p", "o"], "left")
    known = materialised(whole.select("s", "p", "o", F.coalesce("_m.state", F.lit("current")).alias("state"), F.coalesce("_m.strength", F.lit(1.0)).alias("strength"), "_m.seen", "_m.until"))
    current, keys = known.where("state = 'current'"), ["s", "p", "o"]
    states = current.where("p = 'state'")
    newest = states.groupBy("s").agg(F.max(F.struct("seen", "o")).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    old = states.join(newest, "s").where(F.col("o") != F.col("_last.o"))
    score = memory.salience.groupBy("node").agg(F.max("score").alias("score"))
    tied = current.where(F.col("p").isin(*rules.associations))
    dull = score.where(F.col("score") < rules.dull).select("node")
    pruned = tied.join(dull.withColumnRenamed("node", "s"), "s", "left_semi").join(dull.withColumnRenamed("node", "o"), "o", "left_semi")
    weaker = tied.withColumn("_to", F.col("strength") * F.pow(F.lit(0.5), _days(now, F.col("seen")) / F.lit(rules.half_life))).where((F.col("_to") < F.col("strength")) & (F.col("seen") < now))
    fresh = candidates.where((F.col("score") >= rules.sure) & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).select(*keys).distinct().join(known, keys, "left_anti")
    found = {
        "supersede": old, "remove": known.where(F.col("state") == "archived").where(_days(now, F.col("until")) >= rules.deep_after), "prune": pruned,
        "archive": weaker.where(F.col("_to") < rules.faded), "decay": weaker.where(F.col("_to") >= rules.faded), "propose": fresh.withColumn("strength", F.lit(1.0)),
    }
    parts = [df.select(*keys, F.lit(ACTIONS.index(name)).alias("_rank"), (F.col("_to") if name in ("archive", "decay") else F.col("strength")).alias("strength")) for name, df in found.items()]
    one = union_all(parts).groupBy(*keys).agg(F.min(F.struct("_rank", "strength")).alias("_d"))
    return one.select(*keys, F.get(F.array(*map(F.lit, ACTIONS)), F.col("_d._rank")).alias("action"), "_d.strength")


def applied(memory: Memory, decided: DataFrame, now: Column) -> Memory:
    """The tables after the decisions: removed and pruned edges go to the archive, the others' sidecars are rewritten."""
    keys = ["s", "p", "o"]
    gone = decided.where("action IN ('remove', 'prune')")
    edges = memory.edges.join(gone, keys, "left_anti").unionByName(decided.where("action = 'propose'").select(*keys))
    kept = memory.sidecar.join(decided.where("action <> 'propose'"), keys, "left_anti")
    state = F.when(F.col("action") == "supersede", "superseded").when(F.col("action") == "archive", "archived").otherwise("current")
    until = F.when(F.col("action").isin("supersede", "archive"), now)
    changed = decided.where("action NOT IN ('remove', 'prune')").join(memory.sidecar.groupBy(*keys).agg(F.max("seen").alias("_seen")), keys, "left")
    seen = F.when(F.col("action").isin("decay", "archive", "propose"), now).otherwise(F.col("_seen"))  # strength counts from here on
    rows = changed.select(*keys, state.alias("state"), "strength", seen.alias("seen"), until.alias("until"))
    archive = memory.archive.unionByName(gone.select(*keys, F.col("action").alias("reason")))
    return Memory(edges, kept.select(*keys, "state", "strength", "seen", "until").unionByName(rows), memory.salience, archive)


def saved(memory: Memory, folder: str) -> Memory:
    """Write all tables under a folder and read them from there."""
    out = []
    for name, df in memory._asdict().items():
        df.write.parquet(f"{folder}/{name}")
        out.append(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"))
    return Memory(*out)


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The highest finished version under a folder; a version is finished once its mark is written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    names = [f.getPath() for f in system.listStatus(path)]
    done = [int(p.getName()[8:]) for p in names if p.getName().startswith("version=") and system.exists(p.suffix("/_DONE"))]
    return max(done, default=None)


def consolidate(memory: Memory, candidates: DataFrame, rules: Rules, now: Column, folder: str | None = None) -> tuple[DataFrame, Memory]:
    """(decisions, tables): a dry run without a folder, which leaves the tables as they are; else the next version, written under it.

    All tables of a version are written before its mark, so readers that go by `newest_version` see all of a pass or nothing.  A pass
    that died leaves a version without a mark, and the next one takes a new number.
    """
    decided = materialised(decisions(memory, candidates, rules, now))
    if folder is None:
        return decided, memory
    spark = decided.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [int(f.getPath().getName()[8:]) for f in system.listStatus(path) if f.getPath().getName().startswith("version=")] if system.exists(path) else []
    here = f"{folder}/version={max(taken, default=-1) + 1}"
    after = saved(applied(memory, decided, now), here)
    system.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{here}/_DONE")).close()
    return decided, after


def decision_counts(decided: DataFrame) -> DataFrame:
    """(action, n, share): a pass's report."""
    n = decided.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # six rows
