"""Keyword planning of whole tables of prompts from dictionary tables: phrases by longest match, entities, dates, plan JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import language as N

#: Words of phrases; whole words of a text, letters beyond ASCII among them; words that may be names.
_TOKEN, _WHOLE, _NAME = "[a-z0-9_]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+", "^[A-Z][a-z]+$"


def phrase_matches(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, kind, label, start, size): phrases of a dictionary in texts, the longest where one lies inside another.

    `texts` has id and text; `dictionary` phrase, kind and label, with phrases of any number of words; both sides are compared as
    lower-case runs of letters, digits and underscores.  Every run of as many words as some phrase has meets the phrases in one
    join, so the dictionary may be as large as the texts.  A match is dropped if a longer one of its kind, or one
    that begins before it, covers it.  Nulls are left out; repeated phrases are one.
    """
    known = dictionary.where("phrase IS NOT NULL AND kind IS NOT NULL AND label IS NOT NULL").select(F.regexp_extract_all(F.lower("phrase"), F.lit(_TOKEN), F.lit(0)).alias("_w"), "kind", "label").where(F.size("_w") > 0)
    known = known.select(F.array_join("_w", " ").alias("_p"), F.size("_w").alias("size"), "kind", "label").distinct()
    sizes = sorted(r.size for r in known.select("size").distinct().collect())
    words = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0)).alias("_w")).where(F.size("_w") > 0)
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice("_w", i + 1, n), " ").alias("p")))
    none = F.array().cast("array<struct<start:int,size:int,p:string>>")
    every = F.concat(*[F.when(F.size("_w") >= n, runs(n)).otherwise(none) for n in sizes]) if sizes else none
    spans = words.select("id", F.explode(every).alias("_s")).select("id", "_s.start", "_s.size", F.col("_s.p").alias("_p"))
    met = spans.join(known, ["_p", "size"])
    before = Window.partitionBy("id", "kind").orderBy("start", F.desc("size"))  # the matches of one text
    ends = met.groupBy("id", "kind", "start", "size").agg(F.min("label").alias("label")).withColumn("_end", F.col("start") + F.col("size"))
    reach = F.max("_end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("_end"))).select("id", "kind", "label", "start", "size")


def first_labels(matches: DataFrame, kind: str, name: str) -> DataFrame:
    """(id, name): the distinct labels of a kind in order of their first place."""
    once = matches.where(F.col("kind") == kind).groupBy("id", "label").agg(F.min("start").alias("_s"))
    return once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "label"))), lambda x: x["label"]).alias(name))


def named_entities(texts: DataFrame, stop: DataFrame) -> DataFrame:
    """(id, entities): capitalised words that are not among the `stop` words (word, any case), in order of their first place."""
    names = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(_WHOLE), F.lit(0))), lambda w: w.rlike(_NAME))
    words = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.posexplode(names).alias("_p", "_e"))
    kept = words.withColumn("_k", F.lower("_e")).join(stop.select(F.lower("word").alias("_k")).where("_k IS NOT NULL").distinct(), "_k", "left_anti")
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"]).alias("entities"))


def date_range(text: Column, year: int) -> tuple[Column, Column]:
    """First and last day of what a prompt names: `in` a month, or `between` two; a year may follow each month.

    A month without a year takes the other one's, else `year`.  Null where neither form is there.
    """
    low, month = F.lower(text), f"({'|'.join(N.MONTHS)})"
    one, two = rf"\bin\s+{month}\b(?:\s+([0-9]{{4}})\b)?", rf"\bbetween\s+{month}\b(?:\s+([0-9]{{4}}))?\s+and\s+{month}\b(?:\s+([0-9]{{4}}))?"
    found = lambda rx, g: F.when(F.regexp_extract(low, rx, g) != "", F.regexp_extract(low, rx, g))
    number = lambda name: F.array_position(F.array(*[F.lit(m) for m in N.MONTHS]), name).cast("int")
    single = low.rlike(one)
    first, last = F.when(single, found(one, 1)).otherwise(found(two, 1)), F.when(single, found(one, 1)).otherwise(found(two, 3))
    y1, y2 = F.when(single, found(one, 2)).otherwise(F.coalesce(found(two, 2), found(two, 4))), F.when(single, found(one, 2)).otherwise(F.coalesce(found(two, 4), found(two, 2)))
    begin = F.make_date(F.coalesce(y1, F.lit(str(year))).cast("int"), number(first), F.lit(1))
    return begin, F.last_day(F.make_date(F.coalesce(y2, F.lit(str(year))).cast("int"), number(last), F.lit(1)))


def planned(prompts: DataFrame, dictionary: DataFrame, stop: DataFrame, year: int) -> DataFrame:
    """(id, entities, topics, tones, entity_mode, bucket, date_from, date_to) of prompts (id, text).

    The dictionary's kinds are topic, tone and joint; a joint phrase and two entities or more make an intersection.  Prompts that
    repeat an id are left to the caller to tell apart.
    """
    matches = phrase_matches(prompts, dictionary)
    begin, end = date_range(F.col("text"), year)
    out = prompts.where("id IS NOT NULL").select("id", N.temporal_bucket(F.col("text")).alias("bucket"), begin.alias("date_from"), end.alias("date_to"))
    out = out.join(named_entities(prompts, stop), "id", "left")
    for kind, name in (("topic", "topics"), ("tone", "tones"), ("joint", "_joint")):
        out = out.join(first_labels(matches, kind, name), "id", "left")
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, empty).alias(c)
    mode = F.when((F.size(F.coalesce("_joint", empty)) > 0) & (F.size(F.coalesce("entities", empty)) > 1), "intersection").otherwise("union")
    return out.select("id", some("entities"), some("topics"), some("tones"), mode.alias("entity_mode"), "bucket", "date_from", "date_to")


def outer_object(text: Column) -> Column:
    """The JSON object of an answer: what is between the first opening and the last closing brace, code fences and talk around it left out; null without one."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def complete_objects(text: Column) -> Column:
    """The objects without inner objects of an answer that was cut off, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
