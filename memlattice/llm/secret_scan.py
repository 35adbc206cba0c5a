"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only.  A text is split at a pattern's matches, and the lengths of
parts and matches, summed up, are the matches' places in code points.  What the patterns
found is blanked, kind after kind, with as many spaces; every run of 16 or more
key characters that is left and has a letter is a candidate.  Two first-order Markov
models over the 67 key characters, one of random strings and one of ordinary
identifiers, give each transition a weight of thousandths of a log-likelihood ratio (a
transition's share leans on its second character's share, which has 0.5 added); a candidate whose weights sum to more than
`margin` is a span of kind `markov`.  No row is shuffled: the models are one array of
128 x 128 integers, whatever the corpus.

The models learn from labelled samples (value, random).  `labelled_samples` takes them
from about `sample_rows` documents, all where there are fewer: what the patterns found
there and digests of the ids (hexadecimal and base 64) are random; whole runs of 4
to 15 key characters outside of the patterns' matches are ordinary.

Defined results: a null text counts as empty; an empty text or table has no spans or
rows; without samples every weight is 0 and nothing is added; rows that repeat are
scanned one by one, and null ids stay null; other columns are ignored.  A match is
the longest one at the leftmost place, and what is too short is dropped after that.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.shared import narrow, text_or_empty


class Kind(NamedTuple):
    """A pattern, and the group of it that must have `least` characters."""

    name: str
    pattern: str
    group: int
    least: int


#: Fixed patterns in the order of kinds.  A run that is too short for `access` or `hex` holds no match, so the pattern has the least length itself.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", "[0-9a-f]{32,}", 0, 32),
)
ADDED = "markov"
#: What keys are written in: candidates are runs of 16 or more, samples of ordinary identifiers runs of 4 to 15.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE, SHORT_RUN, LONGEST_SHORT = "[A-Za-z0-9+/_=-]{16,}", "[A-Za-z0-9+/_=-]{4,}", 15
#: Thousandths of a natural log-likelihood ratio that a candidate must exceed.
MARGIN = 20_000
#: Documents that samples are taken from, as an expected number.
SAMPLE_ROWS = 5_000
#: Added to every character's count, and the weight of a character's own share among its transitions.
SMOOTHING, LEAN = 0.5, 4.0
#: Elements of an array that are summed in one block, characters that are scored as one array.
_BLOCK, _PIECE = 64, 1024
_STEPS = ("_parts", "_hits", "_group", "_sizes", "_ends")
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def running_total(values: Column) -> Column:
    """Inclusive sums of an array of longs; by blocks, since a step copies the sums before it."""

    def add(acc: Column, sums: Column, by: Column) -> Column:
        return F.struct((acc["total"] + by).alias("total"), F.concat(acc["sums"], sums).alias("sums"))

    begin = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    block = lambda i: F.aggregate(F.slice(values, i, _BLOCK), begin, lambda acc, x: add(acc, F.array(acc["total"] + x), x))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_BLOCK)), block)
    shifted = lambda acc, b: add(acc, F.transform(b["sums"], lambda x: x + acc["total"]), b["total"])
    return F.aggregate(blocks, begin, shifted, lambda acc: acc["sums"])


def _long(text: Column) -> Column:
    return F.length(text).cast("long")


def with_matches(rows: DataFrame, text: str, kind: Kind) -> DataFrame:
    """Adds _parts (between the matches), _hits, _group and _ends (in code points); null where nothing matches.

    What is used twice is a column of its own, which the optimiser does not copy into its uses.
    """
    met, pattern = F.col(text).rlike(kind.pattern), F.lit(kind.pattern)
    taken = lambda group: F.when(met, F.regexp_extract_all(F.col(text), pattern, F.lit(group)))
    cut = rows.withColumns({"_parts": F.when(met, F.split(F.col(text), kind.pattern, -1)), "_hits": taken(0)})
    cut = cut.withColumn("_group", taken(kind.group) if kind.group else F.col("_hits"))
    sizes = F.zip_with(F.slice("_parts", F.lit(1), F.size("_hits")), F.col("_hits"), lambda p, h: _long(p) + _long(h))
    return cut.withColumn("_sizes", sizes).withColumn("_ends", F.when(F.col("_hits").isNotNull(), running_total(F.col("_sizes"))))


def _spans(rank: int, least: int) -> Column:
    """The matches whose group is long enough, as (start, rank, end, value)."""
    whole = F.transform(
        F.arrays_zip("_hits", "_ends", "_group"),
        lambda x: F.struct((x["_ends"] - _long(x["_hits"])).alias("start"), F.lit(rank).alias("rank"), x["_ends"].alias("end"), x["_group"].alias("value")),
    )
    return F.coalesce(F.filter(whole, lambda x: F.length(x["value"]) >= least), F.array().cast(_SPANS))


def _blanked(rows: DataFrame, kind: Kind) -> DataFrame:
    """_rest with spaces in place of a kind's matches, where the text has any."""
    met = with_matches(rows.withColumn("_open", F.when(F.size(kind.name) > 0, F.col("_rest"))), "_open", kind)
    pieces = F.transform(
        F.arrays_zip("_parts", "_hits", "_group"),  # no match follows the last part
        lambda x: F.concat(x["_parts"], F.coalesce(F.when(F.length(x["_group"]) >= kind.least, F.repeat(F.lit(" "), F.length(x["_hits"]))), x["_hits"], F.lit(""))),
    )
    rest = F.when(F.col("_hits").isNull(), F.col("_rest")).otherwise(F.array_join(pieces, ""))
    return met.withColumn("_rest", rest).drop("_open", *_STEPS)


def base_spans(docs: DataFrame, kinds: tuple[Kind, ...] = BASE) -> DataFrame:
    """(doc_id, _rest, one array of spans per kind): _rest is the text with all of them blanked."""
    rows = narrow(docs).select("doc_id", text_or_empty().alias("_text"))
    for rank, kind in enumerate(kinds):
        rows = with_matches(rows, "_text", kind).withColumn(kind.name, _spans(rank, kind.least)).drop(*_STEPS)
    rows = rows.withColumnRenamed("_text", "_rest")
    for kind in kinds:
        rows = _blanked(rows, kind)
    return rows


def transitions(value: Column, before: Column) -> Column:
    """128 times the code of each character's predecessor plus its own; `before` is the first one's predecessor."""
    codes = F.transform(F.split(value, "", -1), lambda c: F.ascii(c))
    return F.zip_with(F.concat(F.array(before), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * 128 + b)


def labelled_samples(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(value, random) from about `sample_rows` documents, chosen by a hash of their ids."""
    drawn = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long")
    share = min(1.0, sample_rows / max(docs.count(), 1))
    found = base_spans(narrow(docs).where(drawn < F.lit(math.ceil(share * 2**32))))
    digest = F.sha2(F.concat(F.lit("random:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hits = F.concat(*[F.transform(kind.name, lambda s: s["value"]) for kind in BASE])
    short = F.filter(F.regexp_extract_all("_rest", F.lit(SHORT_RUN), F.lit(0)), lambda v: F.length(v) <= LONGEST_SHORT)
    rows = found.select(F.concat(F.array(digest, F.base64(F.unhex(digest))), hits).alias("_random"), short.alias("_ordinary"))

    def marked(column: str, random: bool) -> Column:
        return F.transform(column, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))

    labelled = F.concat(marked("_random", True), marked("_ordinary", False))
    return rows.select(F.explode_outer(labelled).alias("_s")).where("_s IS NOT NULL").select("_s.value", "_s.random")


def markov_weights(samples: DataFrame) -> list[int]:
    """Thousandths of the log-likelihood ratio of each transition; only counts of at most 68 x 67 transitions reach the driver."""
    moves = F.col("value").rlike("^[A-Za-z0-9+/_=-]+$")
    values = samples.where(moves).groupBy("value", "random").agg(F.count(F.lit(1)).alias("_n"))
    pairs = values.select("random", "_n", F.explode_outer(transitions(F.col("value"), F.lit(0))).alias("_t"))
    letters = [ord(c) for c in ALPHABET]
    after = {(kind, a): dict.fromkeys(letters, 0) for kind in (True, False) for a in (0, *letters)}
    for r in pairs.groupBy("random", "_t").agg(F.sum("_n").alias("n")).collect():
        after[r.random, r._t // 128][r._t % 128] = r.n
    weights = [0] * (128 * 128)
    shares = {}
    for kind in (True, False):
        seen = {b: sum(after[kind, a][b] for a in (0, *letters)) + SMOOTHING for b in letters}
        total = sum(seen.values())
        for a in (0, *letters):
            n = sum(after[kind, a].values())
            shares[kind, a] = {b: (after[kind, a][b] + LEAN * (seen[b] / total)) / (n + LEAN) for b in letters}
    for a in (0, *letters):
        for b in letters:
            weights[a * 128 + b] = math.floor(1000 * math.log(shares[True, a][b] / shares[False, a][b]))
    return weights


def log_ratio(value: Column, weights: Column) -> Column:
    """Sum of a run's weights, piece by piece."""
    pieces = F.regexp_extract_all(value, F.lit(f".{{1,{_PIECE}}}"), F.lit(0))
    before = F.concat(F.array(F.lit("")), F.transform(pieces, lambda p: F.substring(p, -1, 1)))  # the code of an empty text is 0
    whole = lambda p, b: F.aggregate(transitions(p, F.ascii(b)), F.lit(0).cast("long"), lambda acc, t: acc + F.get(weights, t))
    sums = F.zip_with(pieces, F.slice(before, F.lit(1), F.size(pieces)), whole)
    return F.aggregate(sums, F.lit(0).cast("long"), lambda acc, x: acc + x)


def scan(docs: DataFrame, weights: list[int], margin: int = MARGIN) -> DataFrame:
    """(doc_id, assign, access, hex, markov): spans (start, rank, end, value) of each row's text."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    kind = Kind(ADDED, CANDIDATE, 0, 16)
    rows = with_matches(base_spans(docs), "_rest", kind).withColumn(ADDED, _spans(len(BASE), 16))
    chosen = F.filter(ADDED, lambda s: s["value"].rlike("[A-Za-z]") & (log_ratio(s["value"], table) > margin))
    return rows.select("doc_id", *[k.name for k in BASE], chosen.alias(ADDED))


def span_rows(found: DataFrame) -> DataFrame:
    """One row (doc_id, kind, start, end, value) per span of `scan`.

    `explode` would have the optimiser repeat the scan inside a filter on the array's size; `explode_outer` does not.
    """
    every = F.concat(*[k.name for k in BASE], ADDED)
    rows = found.select("doc_id", F.explode_outer(every).alias("_s")).where("_s IS NOT NULL")
    return rows.select("doc_id", F.get(_names(), F.col("_s.rank")).alias("kind"), "_s.start", "_s.end", "_s.value")


def _names() -> Column:
    return F.array(*[F.lit(k.name) for k in BASE], F.lit(ADDED))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(_names(), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digest(docs: DataFrame, weights: list[int], margin: int = MARGIN) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of each row."""
    names = [k.name for k in BASE]
    rows = scan(docs, weights, margin)
    return rows.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c}") for c in [*names, ADDED]],
        F.sha2(_joined(F.concat(*names)), 256).alias("base_sha256"),
        _joined(F.concat(*names, ADDED)).alias("spans"),
    )
