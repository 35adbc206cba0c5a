"""Binary document files as tables: Word sections by heading style and mail messages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of files below a folder, each once, in the store Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").dropDuplicates(["path"])


def _docx(content: bytes) -> list[tuple[int, str, str]]:
    """(level, heading, content) of a Word document; a damaged file gives none."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out: list[tuple[int, str, list[str]]] = [(1, "", [])]
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        found = re.match(r"Heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
        if found and text:
            out.append((int(found[1]), text, []))
        elif text:
            out[-1][2].append(text)
    return [(level, head, "\n".join(body)) for level, head, body in out if head or body]


def docx_sections(files: DataFrame) -> DataFrame:
    """(path, idx, level, heading, content) of Word files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, *s) for p, c in zip(frame["path"], frame["content"], strict=True) for i, s in enumerate(_docx(c))]
            yield pd.DataFrame(rows, columns=["path", "idx", "level", "heading", "content"])

    return files.mapInPandas(run, "path string, idx int, level int, heading string, content string")


def _strip(value: str | None) -> str | None:
    return value.strip().strip("<>") if value else None


def _mail(content: bytes) -> tuple:
    m = message_from_bytes(content, policy=policy.default)
    references = (m["References"] or "").split()
    parent = _strip(m["In-Reply-To"]) or (_strip(references[-1]) if references else None)
    try:
        date = parsedate_to_datetime(m["Date"]).replace(tzinfo=None) if m["Date"] else None
    except (TypeError, ValueError):
        date = None
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = re.sub(r"<[^>]+>", " ", text)
    return _strip(m["Message-ID"]), parent, date, str(m["From"] or ""), str(m["Subject"] or ""), " ".join(text.split())


def mail_messages(files: DataFrame) -> DataFrame:
    """(path, msgid, in_reply_to, date, sender, subject, body) of mail files; the parent falls back to the last reference."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *_mail(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "msgid", "in_reply_to", "date", "sender", "subject", "body"])

    out = files.mapInPandas(run, "path string, msgid string, in_reply_to string, date timestamp, sender string, subject string, body string")
    return out.withColumn("msgid", F.coalesce("msgid", "path"))
