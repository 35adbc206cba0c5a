"""Rule-based language functions: query planning, assertions, temporal features, presentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months, tone words, topic words, and words that are never entities.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STOP_ENTITIES = ("The", "What", "When", "Where", "Who", "Why", "How", "Did", "Does", "Is", "Are", "Was", "Were", "Show", "Find", "List", "Tell", "And", "For", "With")
BUCKETS = {"today": "today", "this week": "this_week", "last week": "last_week", "this month": "this_month"}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text has any of some words."""
    low = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def prompt_entities(prompt: Column) -> Column:
    """Capitalised words that are no stop words, in first-seen order."""
    words = F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\b([A-Z][A-Za-z0-9]+)\b"), F.lit(1)))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_ENTITIES]))


def entity_mode(prompt: Column) -> Column:
    """intersection where the prompt asks for both or all together, else union."""
    return F.when(F.lower(prompt).rlike(r"\b(both|together|and also)\b"), "intersection").otherwise("union")


def temporal_bucket(prompt: Column) -> Column:
    """today, this_week, last_week or this_month; null without one."""
    low, out = F.lower(prompt), F.lit(None).cast("string")
    for words, name in reversed(BUCKETS.items()):
        out = F.when(low.contains(words), name).otherwise(out)
    return out


def anchor_word(prompt: Column, word: str) -> Column:
    """The word after `before` or `after`, an article skipped; null without one."""
    found = F.regexp_extract(F.lower(prompt), rf"\b{word}\s+(?:the\s+|a\s+|an\s+|we\s+|i\s+)?([a-z0-9]+)", 1)
    return F.when(found != "", found)


def month_range(prompt: Column, year: int) -> tuple[Column, Column]:
    """First and last day of the first month named, or of the span between two; null without one."""
    names = F.regexp_extract_all(F.lower(prompt), F.lit(rf"\b({'|'.join(MONTHS)})\b"), F.lit(1))
    number = lambda x: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), x)
    first = F.when(F.size(names) > 0, number(F.get(names, F.lit(0)))).cast("int")
    last = F.when(F.size(names) > 1, number(F.get(names, F.lit(1)))).otherwise(first).cast("int")
    return F.make_date(F.lit(year), first, F.lit(1)), F.last_day(F.make_date(F.lit(year), last, F.lit(1)))


#: A state's key and value: most words and characters of either, words that come before a key, links between key and value.
KEY_WORDS, KEY_CHARS, VALUE_CHARS = 6, 61, 120
DETERMINERS, COPULAS, ONE_WORD_CHANGES, CHANGES_WITH_TO = ("the", "a", "an", "our", "my"), ("is", "are", "was"), ("became",), ("changed", "moved", "switched", "updated")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _first_place(words: Column, fits) -> Column:
    """0-based place of the first word from the second on for which fits(word, next word); null without one."""
    places = F.transform(words, lambda w, i: F.when((i > 0) & fits(F.lower(w), F.lower(F.coalesce(F.get(words, i + 1), F.lit("")))), i))
    return F.array_min(F.filter(places, lambda i: i.isNotNull()))


def _state(key: Column, value: Column) -> Column:
    """struct(key, value) where both are fit to be a state; null otherwise."""
    named = _words(F.lower(key))
    bare = F.when((F.size(named) > 1) & F.get(named, F.lit(0)).isin(*DETERMINERS), F.slice(named, 2, KEY_WORDS + 1)).otherwise(named)
    plain = F.forall(named, lambda w: w.rlike("^[a-z0-9_-]+$")) & F.get(named, F.lit(0)).rlike("^[a-z]")
    sized = F.size(bare).between(1, KEY_WORDS) & (F.length(F.array_join(named, " ")) <= KEY_CHARS)
    said = F.trim(F.rtrim(F.trim(value), F.lit(".,;")))
    return F.when(plain & sized & F.length(said).between(1, VALUE_CHARS), F.struct(F.array_join(bare, " ").alias("key"), said.alias("value")))


def field(line: Column) -> Column:
    """struct(key, value) of a line that has a colon or an equals sign: what is before the first one and what is after it."""
    places = F.array(F.instr(line, ":"), F.instr(line, "="))
    at = F.array_min(F.filter(places, lambda p: p > 0))
    return _state(F.substring(line, F.lit(1), at - 1), F.substring(line, at + 1, F.length(line)))


def assertion(line: Column) -> Column:
    """struct(key, value) of a line that asserts a state; null otherwise.

    A line is first read as a field.  Failing that it is cut at its first copula from the second word on (a `now` after it
    goes with it), then at its first verb of change.  The key must be one to six words of letters, digits, - and _ that begin with a letter,
    without a determiner; the value, without closing marks, 1 to 120 characters.
    """
    words = _words(line)
    joined = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    copula = _first_place(words, lambda w, _: w.isin(*COPULAS))
    now = F.when(F.lower(F.coalesce(F.get(words, copula + 1), F.lit(""))) == "now", 1).otherwise(0)
    change = _first_place(words, lambda w, after: w.isin(*ONE_WORD_CHANGES) | (w.isin(*CHANGES_WITH_TO) & (after == "to")))
    long = F.when(F.lower(F.get(words, change)).isin(*ONE_WORD_CHANGES), 1).otherwise(2)
    rest = F.size(words)
    by_copula = F.when(copula.isNotNull(), _state(joined(F.lit(1), copula), joined(copula + now + 2, rest)))
    by_change = F.when(change.isNotNull(), _state(joined(F.lit(1), change), joined(change + long + 1, rest)))
    return F.coalesce(F.when(line.rlike("[:=]"), field(line)), by_copula, by_change)


def temporal_features(text: Column, heading: Column) -> Column:
    """Six features: a date, an as-of mark, a decision word, decisions up to three, a dated heading, a plan word."""
    date = r"\b\d{4}-\d{2}-\d{2}\b"
    low = F.lower(text)
    flag = lambda c: c.cast("double")
    n = F.regexp_count(low, F.lit(r"\b(decided|agreed|approved)\b"))
    return F.array(
        flag(text.rlike(date)), flag(low.rlike(r"\bas of\b")), flag(n > 0), F.least(n, F.lit(3)) / F.lit(3.0), flag(heading.rlike(date)), flag(low.rlike(r"\b(plan|roadmap|will)\b"))
    )


def presentation(prompt: Column, results: Column) -> Column:
    """How an answer is shown: table, timeline, list, direct or synthesis."""
    return (
        F.when(has_any(prompt, ("table", "compare", "versus")), "table")
        .when(has_any(prompt, ("timeline", "history", "when did")), "timeline")
        .when(has_any(prompt, ("list", "all the", "which")), "list")
        .when(results <= 1, "direct")
        .otherwise("synthesis")
    )


def cheap_spans(text: Column, most: int = 12) -> Column:
    """Title-case runs, acronyms and quoted spans, distinct without regard to case, `most` at most."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b"), F.lit(1)),
        F.regexp_extract_all(text, F.lit('"([^"]{2,60})"'), F.lit(1)),
    )
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.slice(F.aggregate(found, F.array().cast("array<string>"), keep), 1, most)
