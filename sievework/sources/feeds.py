"""Parsers of what a collection run fetches: channel previews, word documents, JSON documents and append-only event logs."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nodes import TEXT, ancestors, node_table, words_of

#: The classes of a message and of its text in a channel's preview page, and the attribute that names both.
MESSAGE, MESSAGE_TEXT, POST = "tgme_widget_message", "tgme_widget_message_text", "data-post"
#: A feed's own lengths.
TITLE_CHARS, SUMMARY_CHARS = 120, 400


def channel_posts(pages: DataFrame, title_chars: int = TITLE_CHARS, summary_chars: int = SUMMARY_CHARS) -> DataFrame:
    """pages (page_id, html) -> channel, post_id, posted_at, title, summary of the messages that have a text.

    A message is an element of its class that names its post; its text and time are the first such elements inside, in any
    order and with any further attributes. A line ends where the page breaks it; a title is the first line."""
    nodes = node_table(pages)
    named = F.split_part(F.try_element_at("attrs", F.lit(POST)), F.lit("/"), F.lit(-1)).try_cast("long")
    messages = nodes.filter(F.array_contains(words_of("class"), MESSAGE) & named.isNotNull()).select("page_id", F.col("begin").alias("message"), F.split_part(F.try_element_at("attrs", F.lit(POST)), F.lit("/"), F.lit(1)).alias("channel"), named.alias("post_id"))
    inner = lambda found, *columns: ancestors(found, *columns).withColumnRenamed("ancestor", "message").join(messages.select("page_id", "message"), ["page_id", "message"])
    holders = inner(nodes.filter(F.array_contains(words_of("class"), MESSAGE_TEXT))).groupBy("page_id", "message").agg(F.min("begin").alias("holder"))
    times = inner(nodes.filter((F.col("tag") == "time") & F.map_contains_key("attrs", "datetime")).withColumn("at", F.try_element_at("attrs", F.lit("datetime"))), "at").groupBy("page_id", "message").agg(F.min_by("at", "begin").alias("posted_at"))
    parts = ancestors(nodes.filter(F.col("tag") == TEXT), "text").withColumnRenamed("ancestor", "holder").join(holders, ["page_id", "holder"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda p: p["text"]), "")
    texts = parts.groupBy("page_id", "message").agg(F.regexp_replace(F.regexp_replace(lines, "\n{2,}", "\n"), r"^[ \n]+|[ \n]+$", "").alias("text")).filter("text != ''")
    met = messages.join(texts, ["page_id", "message"]).join(times, ["page_id", "message"], "left")
    return met.select("channel", "post_id", F.coalesce("posted_at", F.lit("")).alias("posted_at"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, title_chars).alias("title"), F.substring("text", 1, summary_chars).alias("summary"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of a word document's paragraphs that have a text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ET.fromstring(archive.read("word/document.xml"))
    out = []
    for paragraph in root.iter(f"{_WORD}p"):
        style = paragraph.find(f"{_WORD}pPr/{_WORD}pStyle")
        text = "".join(t.text or "" for t in paragraph.iter(f"{_WORD}t"))
        if text.strip():
            out.append(("" if style is None else style.get(f"{_WORD}val", ""), text))
    return out


def written_document(paragraphs: list[str]) -> bytes:
    """A word document of plain paragraphs, the first one styled as a heading."""
    ET.register_namespace("w", _WORD[1:-1])
    root = ET.Element(f"{_WORD}document")
    body = ET.SubElement(root, f"{_WORD}body")
    for k, text in enumerate(paragraphs):
        p = ET.SubElement(body, f"{_WORD}p")
        if not k:
            ET.SubElement(ET.SubElement(p, f"{_WORD}pPr"), f"{_WORD}pStyle").set(f"{_WORD}val", "Heading1")
        ET.SubElement(ET.SubElement(p, f"{_WORD}r"), f"{_WORD}t").text = text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def read_word_documents(files: DataFrame) -> DataFrame:
    """files (id, content: binary), as of spark.read.format("binaryFile") -> id, nth, style, text of each paragraph."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, style, text) for i, content in zip(frame.id, frame.content, strict=True) for n, (style, text) in enumerate(word_paragraphs(bytes(content)))]
            yield pd.DataFrame(rows, columns=["id", "nth", "style", "text"])

    return files.select("id", "content").mapInPandas(run, "id long, nth int, style string, text string")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; a line that doesn't parse ends the scan with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def indexed(rows: DataFrame, key: str) -> DataFrame:
    """rows with error: why a row's key can't index it (missing, or used again), or null. The counts combine before the shuffle."""
    again = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(again, F.col(key) == F.col("again"), "left")
    return met.withColumn("error", F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), "missing").when(F.col("n").isNotNull(), "repeated")).drop("again", "n")
