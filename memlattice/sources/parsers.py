"""Document parsers as DataFrame operators: text, Markdown, HTML, mail, dialogue, code, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.sources.sinks import materialised

#: File kinds by extension.
KINDS = {
    "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text", "eml": "email", "mbox": "email",
    "py": "code", "js": "code", "ts": "code", "go": "code", "rs": "code", "java": "code", "docx": "docx", "pdf": "pdf",
}


def file_kind(path: Column) -> Column:
    """Kind by extension; text where it is unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(kinds[ext], F.lit("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a JSON-lines file; a reject has its raw line."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    from memlattice.sources.sinks import materialised

    rows = materialised(rows)
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select("_corrupt")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, content): parts between blank lines, trimmed, none empty, numbered from 0."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, r"\n\s*\n")).alias("_p", "content"))
    parts = parts.withColumn("content", F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).where("content <> ''")
    return parts.withColumn("idx", (F.row_number().over(Window.partitionBy(id_col).orderBy("_p")) - 1).cast("long")).drop("_p")


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, level, heading, content) by ATX headings; text before the first is a level-1 section."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 1)
    w = Window.partitionBy(id_col).orderBy("pos")
    marked = lines.withColumn("_level", F.length(head)).withColumn("_heading", F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 2))
    marked = marked.withColumn("idx", F.sum(F.when(F.col("_level") > 0, 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy(id_col, "idx").agg(F.max("_level").alias("level"), F.max("_heading").alias("heading"), F.trim(body).alias("content"))
    return out.where("level > 0 OR content <> ''").withColumn("level", F.greatest(F.col("level"), F.lit(1)))


def section_parents(sections: DataFrame, id_col: str) -> DataFrame:
    """Adds parent: the nearest earlier section of a lower level (null at the top)."""
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    lower = [F.max(F.when(F.col("level") < n, F.col("idx"))).over(w) for n in range(1, 8)]
    choice = lower[0]
    for n in range(2, 8):
        choice = F.when(F.col("level") == n, lower[n - 1]).otherwise(choice)
    return sections.withColumn("parent", choice)


class _Sections(HTMLParser):
    """Headings h1 to h6 and the text under each; script, style and head text are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.skip, self.heading, self.in_title = "", [[1, "", []]], 0, None, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = int(tag[1])
            self.parts.append([self.heading, "", []])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        if tag == "title":
            self.in_title = False
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            if self.heading:
                self.parts[-1][1] += data
            else:
                self.parts[-1][2].append(data)


def html_sections(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, idx, level, heading, content) of HTML pages; the title falls back to the first h1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, html in zip(frame["id"], frame["html"], strict=True):
                p = _Sections()
                p.feed(html or "")
                p.close()
                kept = [(level, " ".join(h.split()), " ".join(" ".join(body).split())) for level, h, body in p.parts]
                kept = [x for x in kept if x[1] or x[2]]
                title = " ".join(p.title.split()) or next((h for level, h, _ in kept if level == 1 and h), "")
                rows += [(key, title, i, *x) for i, x in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["id", "title", "idx", "level", "heading", "content"])

    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return source.mapInPandas(run, "id long, title string, idx int, level int, heading string, content string")


def mail_threads(mails: DataFrame) -> DataFrame:
    """(msgid, root, depth, path) of mails with msgid, in_reply_to, date; an unknown parent makes a root.

    Repeated message ids count once.  Every message on a cycle of replies is a root.  `path` orders a thread depth-first by date.
    """
    once = mails.withColumn("_n", F.row_number().over(Window.partitionBy("msgid").orderBy("date"))).where("_n = 1").drop("_n")
    parent = once.join(once.select(F.col("msgid").alias("in_reply_to"), F.lit(True).alias("_known")), "in_reply_to", "left")
    key = F.concat(F.date_format("date", "yyyyMMddHHmmss"), F.lit("|"), F.col("msgid"))
    tree = parent.select("msgid", F.when(F.col("_known") & (F.col("in_reply_to") != F.col("msgid")), F.col("in_reply_to")).alias("parent"), key.alias("k"))
    tree = materialised(tree)
    start = lambda roots: roots.select("msgid", F.col("msgid").alias("root"), F.lit(0).alias("depth"), F.col("k").alias("path"))

    def descend(level: DataFrame, tree: DataFrame) -> DataFrame:
        out, depth = level, 0
        while not level.isEmpty():
            depth += 1
            level = materialised(level.select(F.col("msgid").alias("parent"), "root", "path").join(tree, "parent").select("msgid", "root", F.lit(depth).alias("depth"), F.concat("path", F.lit("/"), "k").alias("path")))
            out = out.unionByName(level)
        return out

    out = descend(start(tree.where("parent IS NULL")), tree)
    cycles = materialised(tree.where("parent IS NOT NULL").join(out, "msgid", "left_anti"))
    if cycles.isEmpty():
        return out
    below, n, left = cycles, -1, cycles.count()
    while n != left:  # who has no reply is on no cycle
        cycles = materialised(cycles.join(cycles.select(F.col("parent").alias("msgid")).distinct(), "msgid", "left_semi"))
        n, left = left, cycles.count()
    return out.unionByName(descend(start(cycles), below.join(cycles, "msgid", "left_anti")))


def speaker_turns(lines: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """Consecutive lines of one speaker merged: (key, turn, speaker, text)."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(speaker).over(w) == F.col(speaker), 0).otherwise(1)
    runs = lines.withColumn("_new", change).withColumn("turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text]), " ")
    return runs.groupBy(key, "turn", speaker).agg(joined.alias(text))


def paired_turns(turns: DataFrame, key: str, text: str) -> DataFrame:
    """Turns 1 and 2, 3 and 4, ... side by side; a last one without answer is left out."""
    n = F.floor((F.col("turn") - 1) / 2)
    return turns.groupBy(key, n.alias("pair")).agg(
        F.max(F.when(F.col("turn") % 2 == 1, F.col(text))).alias("user"), F.max(F.when(F.col("turn") % 2 == 0, F.col(text))).alias("assistant")
    ).where("assistant IS NOT NULL")


def code_units(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, name, content): the module's beginning, then each top-level def or class (Python)."""
    lines = files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    name = F.regexp_extract("line", r"^(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    w = Window.partitionBy(id_col).orderBy("pos")
    marked = lines.withColumn("_name", name).withColumn("idx", F.sum(F.when(name != "", 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(id_col, "idx").agg(F.max("_name").alias("name"), body.alias("content"))
