"""String functions of the memory model: keys, hashes, titles, tokens, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_key(part: Column) -> Column:
    """A key component: itself, or h_ and 16 hex digits of its SHA-256 where it has / or NUL."""
    return F.when(part.rlike("[/\\x00]"), F.concat(F.lit("h_"), F.substring(F.sha2(part, 256), 1, 16))).otherwise(part)


def content_hash(body: Column) -> Column:
    """16 hex digits of a body's SHA-256."""
    return F.substring(F.sha2(body, 256), 1, 16)


def normal_title(title: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    spaced = F.regexp_replace(F.lower(title), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[ .,;:!?\"'()\[\]-]+|[ .,;:!?\"'()\[\]-]+$", "")


def token_estimate(text: Column, least: int = 0) -> Column:
    """A quarter of the characters, `least` at least."""
    n = F.floor(F.length(text) / 4).cast("long")
    return F.greatest(n, F.lit(least).cast("long")) if least else n


def capitalised(text: Column, least: int = 4) -> Column:
    """Distinct capitalised ASCII words of `least` letters or more, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([A-Z][a-z]{{{least - 1},}})"), F.lit(1)))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct-element arrays; 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def node_kind(node: Column) -> Column:
    """Kind of a node by its id; a section's id also begins like a document's, so it is tested first."""
    prefixes = {"E:": "entity", "T:": "topic", "A:": "tone", "D:": "decision", "S:": "session", "U:": "user", "M:": "memory", "ep_": "episode"}
    kind = F.when(node.contains("_sec_"), "section").when(node.startswith("doc_"), "document")
    for prefix, name in prefixes.items():
        kind = kind.when(node.startswith(prefix), name)
    return kind.otherwise("literal")


def bare_name(node: Column) -> Column:
    """An id without its kind prefix."""
    return F.regexp_replace(node, "^(E|T|A|D|S|U|M):", "")


def collapsed_subject(subject: Column) -> Column:
    """A mail subject without reply and forward marks, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(subject), r"^((re|fwd?|aw)\s*:\s*)+", ""), r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    """Trimmed text; null for empty and for the word null."""
    t = F.trim(text)
    return F.when((t == "") | (F.lower(t) == "null"), F.lit(None).cast("string")).otherwise(t)
