"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's shingle set gets a signature of `symbols` MinHash values cut to
16 bits.  Two signatures differ in at most `distance` symbols for all but a
negligible share of pairs at the similarity threshold (see `Plan.miss_rate`).
The signature is split into `chunks` chunks.  By the pigeonhole principle, a
pair within the distance has a chunk with at most `errors` differing symbols,
so each document is filed under every way of leaving `errors` symbols out of
each chunk: all pairs within the distance share a key.

Work stays linear in what is emitted:
* equal shingle sets are one representative before anything is compared;
* keys travel with numbers only; the members of a key that is met twice are named by a hash of
  them all, so keys with the same members become one group, and only members of
  groups fetch their signatures;
* within a group the pairs within the distance are walked breadth-first, and only
  a spanning forest leaves the task; keys with more than `HOT_ROWS` members are
  compared in blocks spread over tasks, every block against every other;
* connected families of such pairs bring their full sets together once, links are
  confirmed exactly there, and again only a forest leaves; a large family is cut
  into blocks that share a hub, and only members not linked to the hub's
  component go on to meet every block.
Components of the confirmed links are the result.  Sets, not ids, are the nodes, so rows
that share an id but not a text stay apart.

Defined results: null or wordless text has an empty set and is linked with
nothing, and so is a row without an id; a text of fewer words than the shingle width is
one shingle; rows that repeat an id are all reported; an empty table gives an empty
result; other columns are ignored.  `drop_near_duplicates` leaves one row of each
component: of the smallest id, of several texts of that id the one of the smallest hash, of
repeated rows the one whose JSON form comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.bytekernel import mix64, row_blocks, shingle_set, text_bytes, word_hashes
from memlattice.llm.components import connected_components
from memlattice.llm.membership import with_ids, without_rows
from memlattice.llm.shared import BIN, LONG, Scratch, narrow, partitions_for, schema, ship, written

#: Bytes of the key rows of a signature, as a multiple of its own.
KEYED_GROWTH = 12.0
#: Members of a key that are compared in one task; larger keys are cut into blocks.
HOT_ROWS = 8192
#: Shingles of a family that are compared in one task; larger families are cut into blocks.
BLOCK_SHINGLES = 1 << 17


@dataclass(frozen=True)
class Plan:
    """Signature and index parameters."""

    symbols: int = 64
    chunks: int = 14
    errors: int = 1
    seed: int = 11

    @property
    def distance(self) -> int:
        """The largest signature distance at which every pair is found."""
        return self.chunks * (self.errors + 1) - 1

    def miss_rate(self, similarity: float) -> float:
        """Chance that a pair of this similarity lies beyond the distance."""
        q = 1 - similarity
        return sum(comb(self.symbols, i) * q**i * (1 - q) ** (self.symbols - i) for i in range(self.distance + 1, self.symbols + 1))

    def keys(self) -> list[tuple[int, np.ndarray]]:
        """(number, columns kept) of each key of a signature."""
        parts = np.array_split(np.arange(self.symbols), self.chunks)
        kept = [np.setdiff1d(p, p[list(drop)]) for p in parts for drop in combinations(range(len(p)), self.errors)]
        return list(enumerate(kept))


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """16-bit MinHash symbols of non-empty sets of hashes."""
    rng = np.random.default_rng(plan.seed)
    a = rng.integers(0, 2**63, plan.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, plan.symbols, dtype=np.uint64)
    out = np.empty((len(sets), plan.symbols), np.uint16)
    for i, s in enumerate(sets):
        least = (s[:512, None] * a + b).min(axis=0)
        for j in range(512, len(s), 512):
            least = np.minimum(least, (s[j : j + 512, None] * a + b).min(axis=0))
        out[i] = mix64(least) & np.uint64(0xFFFF)
    return out


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    for lo, hi in row_blocks(offsets):
        h, at = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            yield shingle_set(h[at[i] : at[i + 1]], width)


SIGNED = schema(doc_id=LONG, n=LONG, d1=LONG, d2=LONG, sig=BIN, digest=LONG)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit digests) of each set."""
    d1 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    d2 = np.array([mix64(s * np.uint64(0xDA942042E4DD58B5)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return np.array([len(s) for s in sets], np.int64), d1.view(np.int64), d2.view(np.int64)


def signed_sets(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """doc_id, set size n, a 128-bit digest of the set (d1, d2), the signature (null without words) and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, width))
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full, plan))
            sig = [next(rows).tobytes() if len(s) else None for s in sets]
            arrays = [batch.column("doc_id"), *map(pa.array, _digests(sets)), pa.array(sig, pa.binary()), batch.column("digest")]
            yield pa.RecordBatch.from_arrays(arrays, names=SIGNED.names)

    ship(docs.sparkSession)
    return docs.withColumn("digest", F.xxhash64("text")).mapInArrow(run, SIGNED)


KEYS = schema(key=LONG, rid=LONG)


def _keys(reps: DataFrame, plan: Plan) -> DataFrame:
    """A row (key, rid) for each key of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = plan.keys()
        weights = mix64(np.arange(1, plan.symbols + 1, dtype=np.uint64)) | np.uint64(1)
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                ids = batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, plan.symbols)
                terms = mix64(sig.astype(np.uint64) + np.uint64(1)) * weights
                keys = np.stack([mix64(terms[:, cols].sum(axis=1, dtype=np.uint64) + np.uint64(number * 2654435761 + 1)) for number, cols in layout], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, len(layout)))], names=KEYS.names)

    return reps.mapInArrow(run, KEYS)


def _met_twice(keys: DataFrame, most: int) -> DataFrame:
    """(key, rid) with a hash of all members for key, of rows sorted by key that meet another; a key of over `most` rows gives (key, null)."""

    def named(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cut)
        group = mix64(np.add.reduceat(mix64(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), cut[:-1]) + sizes.astype(np.uint64)).view(np.int64)
        several = np.repeat(sizes > 1, sizes)
        rows = np.unique(np.stack([np.repeat(group, sizes)[several], ids[several]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], names=KEYS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot: int | None = None
        for batch in batches:
            keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS.names)
            if hot is not None:
                keys, ids = keys[keys != hot], ids[keys != hot]
            if not len(keys):
                continue
            hot = None
            keys, ids = np.concatenate([held_k, keys]), np.concatenate([held_i, ids])
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield named(keys[:last], ids[:last])
            held_k, held_i = keys[last:], ids[last:]
            if len(held_k) > most:
                hot = int(held_k[0])
                yield pa.RecordBatch.from_arrays([pa.array([hot]), pa.array([None], pa.int64())], names=KEYS.names)
                held_k, held_i = held_k[:0], held_i[:0]
        if len(held_k):
            yield named(held_k, held_i)

    return keys.mapInArrow(run, KEYS)


MEMBERS = schema(rid=LONG, member=BIN)


def _members(reps: DataFrame, plan: Plan) -> DataFrame:
    """(rid, member): the number of each representative and its symbols cut to 4 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, plan.symbols)
            low = (sig & np.uint16(15)).astype(np.uint8)
            member = np.concatenate([ids.view(np.uint8).reshape(-1, 8), low[:, 0::2] | (low[:, 1::2] << np.uint8(4))], axis=1)
            ends = np.arange(0, member.size + 1, member.shape[1], dtype=np.int32)
            col = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(member.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids), col], names=MEMBERS.names)

    return reps.mapInArrow(run, MEMBERS)


def _forest(ids: np.ndarray, symbols: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one key within the distance."""
    open_, edges = np.arange(len(ids)), []
    while len(open_) > 1:
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            at = frontier.pop()
            near = (symbols[open_] != symbols[at]).sum(axis=1) <= distance
            if near.any():
                reached = open_[near]
                edges += [(ids[at], x) for x in ids[reached]]
                frontier += reached.tolist()
                open_ = open_[~near]
    return edges


LINKS = schema(a=LONG, b=LONG)


def _links(keyed: DataFrame, plan: Plan) -> DataFrame:
    """Forests within each key of rows (key, member) sorted by key."""
    half = plan.symbols // 2

    def emit(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.ascontiguousarray(members[:, :8]).view(np.int64)[:, 0]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cut)
        two = cut[:-1][sizes == 2]
        x, y = members[two, 8:], members[two + 1, 8:]
        differ = ((x & 15) != (y & 15)).sum(axis=1) + ((x >> 4) != (y >> 4)).sum(axis=1)
        near = two[differ <= plan.distance]
        pairs = [np.stack([ids[near], ids[near + 1]], axis=1)]
        for lo, size in zip(cut[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            packed = members[lo : lo + size, 8:]
            symbols = np.empty((size, 2 * half), np.uint8)
            symbols[:, 0::2], symbols[:, 1::2] = packed & 15, packed >> 4
            found = _forest(ids[lo : lo + size], symbols, plan.distance)
            if found:
                pairs.append(np.array(found, np.int64))
        both = np.concatenate(pairs)
        both = np.unique(np.sort(both, axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 8 + half
        held_k, held_m = np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
        for batch in batches:
            if not len(batch):
                continue
            keys = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
            members = np.concatenate([held_m, text_bytes(batch.column("member"))[0].reshape(-1, width)])
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                a, b = emit(keys[:last], members[:last])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)
            held_k, held_m = keys[last:], members[last:]
        if len(held_k):
            a, b = emit(held_k, held_m)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)

    return keyed.mapInArrow(run, LINKS)


def _dealt(df: DataFrame, key: str, growth: float = 1.0) -> DataFrame:
    """Rows with one key next to each other."""
    return df.repartition(partitions_for(df, growth), key).sortWithinPartitions(key)


def _cells(df: DataFrame, key: str, blocks: str, own: str) -> DataFrame:
    """Each row in every pair of blocks that its own block is in; `cell` names the pair."""
    out = df.withColumn("_own", F.expr(f"pmod(xxhash64({own}), {blocks})")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return out.withColumn("cell", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))


def candidate_links(reps: DataFrame, plan: Plan, step: Scratch) -> DataFrame:
    """A forest of all pairs of representatives (rid, sig) within the signature distance."""
    keys, members = _keys(reps, plan), _members(reps, plan)
    found = step.written(_met_twice(_dealt(keys, "key", KEYED_GROWTH), HOT_ROWS), "keys")
    groups = found.where("rid IS NOT NULL").distinct().join(members, "rid").select("key", "member")
    links = step.written(_links(_dealt(groups, "key"), plan), "links")
    hot = found.where("rid IS NULL").select("key").distinct()
    if hot.isEmpty():
        return links
    rows = keys.join(hot, "key").join(members, "rid").select("key", "member")
    sized = rows.join(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS // 2)).alias("_blocks")), "key")
    cells = _cells(sized, "key", "_blocks", "member").select(F.col("cell").alias("key"), "member")
    return links.union(step.written(_links(_dealt(cells, "key"), plan), "hotlinks"))


def _confirmed(sizes: np.ndarray, flat: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (by position) whose Jaccard similarity is at least percent/100."""
    _, codes = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(codes.max(initial=0)) + 1, bool)
    open_, edges = np.arange(len(sizes)), []
    body = codes
    while len(open_) > 1:
        frontier, open_ = [int(open_[0])], open_[1:]
        body = np.concatenate([codes[starts[i] : starts[i + 1]] for i in open_])
        while frontier and len(open_):
            at = frontier.pop()
            own = codes[starts[at] : starts[at + 1]]
            n = sizes[open_]
            fits = (np.minimum(n, len(own)) * 100 >= np.maximum(n, len(own)) * percent).nonzero()[0]
            if not len(fits):
                continue
            flag[own] = True
            inside = np.concatenate([[0], np.cumsum(flag[body], dtype=np.int64)])
            flag[own] = False
            ends = np.cumsum(n)
            common = inside[ends] - inside[ends - n]
            near = common * 100 >= percent * (n + len(own) - common)
            if near.any():
                reached = open_[near]
                edges += [(at, int(x)) for x in reached]
                frontier += reached.tolist()
                body = body[np.repeat(~near, n)]
                open_ = open_[~near]
    return edges


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Forests of confirmed links within each cell of rows (cell, rid, members) sorted by cell."""

    def emit(ids: list[int], sets: list[bytes]) -> pa.RecordBatch:
        found = dict(zip(ids, sets, strict=True))
        ids = sorted(found)
        parts = [np.frombuffer(found[i], np.uint64) for i in ids]
        edges = _confirmed(np.array([len(p) for p in parts], np.int64), np.concatenate(parts), percent)
        a = np.array([ids[x] for x, _ in edges], np.int64)
        b = np.array([ids[y] for _, y in edges], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []
        for batch in batches:
            for c, i, s in zip(*(batch.column(x).to_pylist() for x in ("cell", "rid", "members")), strict=True):
                if c != cell:
                    if len(ids) > 1:
                        yield emit(ids, sets)
                    cell, ids, sets = c, [], []
                ids.append(i)
                sets.append(s)
        if len(ids) > 1:
            yield emit(ids, sets)

    return rows.mapInArrow(run, LINKS)


def confirmed_links(docs: DataFrame, families: DataFrame, width: int, percent: int, step: Scratch) -> DataFrame:
    """A forest of the true links within families (node, component, n, doc, d1, d2).

    A family within the block size is one cell.  A larger one is cut into blocks, and
    its smallest member, the hub, joins each of them: whoever is linked to the
    hub's component in its block is settled.  Only the strays then meet all
    blocks, so the work follows their number and not the square of the family.
    """
    out = schema(family=LONG, rid=LONG, blocks=LONG, members=BIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, width))
            wanted = np.ones(len(sets), bool)  # another text of the same id has another set
            for name, values in zip(("n", "d1", "d2"), _digests(sets), strict=True):
                wanted &= batch.column(name).to_numpy(zero_copy_only=False) == values
            arrays = [batch.column("family"), batch.column("rid"), batch.column("blocks"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names).filter(pa.array(wanted))

    blocks = families.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("long").alias("blocks"))
    wanted = families.join(blocks, "component").select(F.col("doc").alias("doc_id"), F.col("node").alias("rid"), "n", "d1", "d2", F.col("component").alias("family"), "blocks")
    sets = with_ids(docs, step.written(wanted, "families")).select("text", "family", "rid", "blocks", "n", "d1", "d2").mapInArrow(run, out)
    sets = step.written(sets, "sets").withColumn("_own", F.expr("pmod(xxhash64(rid), blocks)"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    hubs = sets.where("rid = family AND blocks > 1").withColumn("_in", every).where("_in <> _own")
    home = sets.withColumn("_in", F.col("_own")).unionByName(hubs)
    first = step.written(_confirm(_dealt(home.select(F.xxhash64("family", "_in").alias("cell"), "rid", "members"), "cell"), percent), "confirmed")
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return first
    settled = connected_components(first).where("node <> component").select(F.col("node").alias("rid"), "component")
    strays = large.join(settled, "rid", "left").where("coalesce(component, rid) <> family").drop("component")
    groups = strays.groupBy("family").agg(F.ceil(F.sum(F.length("members")) / F.lit(8 * BLOCK_SHINGLES)).cast("long").alias("_groups"))
    group = F.expr("pmod(xxhash64(rid, 1), _groups)")
    some = strays.join(groups, "family").withColumn("_group", group).withColumn("_in", every)
    rest = large.join(groups, "family").withColumn("_in", F.col("_own")).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)))
    cells = some.select(F.xxhash64("family", "_group", "_in").alias("cell"), "rid", "members").union(rest.select(F.xxhash64("family", "_group", "_in").alias("cell"), "rid", "members"))
    return first.union(step.written(_confirm(_dealt(cells, "cell"), percent), "strays"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`.

    Documents whose word shingle sets (A-Z lower-cased) have a Jaccard
    similarity of at least percent/100 are linked; a component's id is its
    smallest doc_id, and that document is kept.
    """
    found = _labelled(docs, width, percent, plan, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labelled(docs: DataFrame, width: int, percent: int, plan: Plan | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, n, root (the component's number; null where no other row has or nears the set) and component_id of every row."""
    plan, spark = plan or Plan(), docs.sparkSession
    docs = narrow(docs, id_col, text_col)
    signed = written(signed_sets(docs, width, plan), "signed")
    groups = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    groups = written(groups.withColumn("rid", F.monotonically_increasing_id()), "groups")  # numbers are settled by writing
    step = Scratch(spark)
    nodes = connected_components(candidate_links(groups.select("rid", "sig"), plan, step))
    families = step.written(nodes.join(groups.drop("sig", "rows").withColumnRenamed("rid", "node"), "node"), "family")
    confirmed = connected_components(confirmed_links(docs, families, width, percent, step)).withColumnRenamed("node", "rid")
    step.clear()
    members = confirmed.join(groups.select("rid", "doc"), "rid")
    least = members.groupBy("component").agg(F.min("doc").alias("_least"))
    linked = members.join(least, "component").select("rid", "component", "_least")
    # sets of one row and no link need no name: they are their own component
    named = groups.drop("sig").join(linked, "rid", "left").where("component IS NOT NULL OR rows > 1")
    named = written(named.select("n", "d1", "d2", F.coalesce("component", "rid").alias("root"), F.coalesce("_least", "doc").alias("_c")), "named")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return signed.drop("sig").join(named, ["n", "d1", "d2"], "left").select(
        "doc_id", "digest", "n", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"), component.alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate component, the one of the smallest id."""
    found = written(_labelled(docs, width, percent, plan, id_col, text_col).where("root IS NOT NULL").groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")), "roots")
    keepers = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("keeper"), F.sum("copies").alias("rows")).where("rows > 1")
    once = F.struct("doc_id", "digest") == F.col("keeper")
    marks = found.join(keepers, "root").where(~once | (F.col("copies") > 1))
    return without_rows(docs, marks.select("doc_id", "digest", once.alias("once")), F.xxhash64(F.col(text_col).cast("string")), id_col)
