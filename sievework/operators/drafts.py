"""Written drafts read line by line: sections, numbered items, their fields, the first date, and what could not be placed.

What a reader would carry from line to line are running sums and last values over a draft's lines in order, all in one
partitioning by draft: the section in force, whether it has an item yet, and the item that a line belongs to.

A line is the first of these that fits: a section's head (a known name alone, or followed by at most HEAD_REST characters);
empty; a field (a label, a colon, a value); an item's first line (a number, then a title of at most TITLE_CHARS); else prose.
Prose of at most SHORT_CHARS is a title where a section is in force that has no item yet. Fields and prose before any item of
their section are warnings. An item's date is the first one in its fields and body. Of repeated fields the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD_REST, TITLE_CHARS, SHORT_CHARS = 6, 120, 60
#: Fixed values of the draft format: labels of fields, the number before a title, dates.
SOURCE_LABELS = ("来源", "消息来源", "Source", "出处")
QUOTE_LABELS = ("原文关键句", "原文", "原文中")
NUMBERED = r"^[*]{0,2}(?:第\s*)?([0-9]{1,2})\s*[条、.．）)]?[*]{0,2}\s*[｜|：:]?\s*(\S.*)$"
DATE = r"(20[0-9]{2})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})"


def label_pattern(labels: tuple[str, ...]) -> str:
    return rf"(?i)^(?:{'|'.join(labels)})\s*[:：]\s*(\S.*)$"


def first_date(text: Column) -> Column:
    """The first date of a text as yyyy-MM-dd, null if it has none; days that no month has are left as they stand."""
    part = lambda k: F.regexp_extract(text, DATE, k)
    return F.when(text.rlike(DATE), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def section_heads(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """lines (doc, n, line), sections (name, code) -> (doc, n, code). Names are met by the prefixes that a head may have, so that
    the table of sections may have any size; of several names the longest one counts, then the least code."""
    longest = sections.agg(F.max(F.length("name"))).first()[0] or 0
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[#>\s]+", ""), r"[【】\[\]（）()]", ""))
    short = lines.select("doc", "n", bare.alias("bare")).filter(F.length("bare").between(1, longest + HEAD_REST))
    prefixes = F.transform(F.sequence(F.greatest(F.length("bare") - HEAD_REST, F.lit(1)), F.length("bare")), lambda k: F.substr("bare", F.lit(1), k))
    met = short.select("doc", "n", F.explode(prefixes).alias("name")).join(sections.filter("name != ''"), "name")
    return met.groupBy("doc", "n").agg(F.min_by("code", F.struct(-F.length("name"), F.col("code"))).alias("code"))


def placed_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Each line with its section, its kind and its item (null before any)."""
    rows = lines.select("doc", "n", F.trim(F.coalesce("line", F.lit(""))).alias("line"))
    rows = rows.join(section_heads(rows, sections), ["doc", "n"], "left")
    source, quote = F.regexp_extract("line", label_pattern(SOURCE_LABELS), 1), F.regexp_extract("line", label_pattern(QUOTE_LABELS), 1)
    rows = rows.withColumns({"source": F.nullif(source, F.lit("")), "quote": F.nullif(quote, F.lit("")), "number": F.nullif(F.regexp_extract("line", NUMBERED, 1), F.lit("")).cast("int"), "numbered": F.trim(F.regexp_replace(F.regexp_extract("line", NUMBERED, 2), r"[*]{2,}", ""))})
    kind = F.when(F.col("code").isNotNull(), "head").when(F.col("line") == "", "empty").when(F.col("source").isNotNull() | F.col("quote").isNotNull(), "field").when((F.col("numbered") != "") & (F.length("numbered") <= TITLE_CHARS), "item").otherwise("prose")
    so_far = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumns({"section_no": F.count("code").over(so_far), "section": F.last("code", ignorenulls=True).over(so_far)})
    opens = (F.col("kind") == "item") | ((F.col("kind") == "prose") & (F.length("line") <= SHORT_CHARS) & (F.col("section_no") > 0))
    before = Window.partitionBy("doc", "section_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("opens", opens).withColumn("seen", F.coalesce(F.max("opens").over(before), F.lit(False)))
    rows = rows.withColumn("starts", (F.col("kind") == "item") | (F.col("opens") & ~F.col("seen")))
    rows = rows.withColumn("count", F.count_if("starts").over(so_far))
    return rows.withColumn("item", F.when((F.col("seen") | F.col("starts")) & ~F.col("kind").isin("head", "empty"), F.col("count")))


def draft_items(placed: DataFrame, fallback: str) -> DataFrame:
    """A row for each item of placed_lines: doc, item, number, section (fallback before any head), title, body, source, quote,
    published. Lines of a body are parted by an empty line."""
    rows = placed.filter("item is not null")
    prose = (F.col("kind") == "prose") & ~F.col("starts")
    dated = F.when(~F.col("starts"), first_date(F.col("line")))
    title = F.when(F.col("kind") == "item", F.col("numbered")).otherwise(F.col("line"))
    out = rows.groupBy("doc", "item").agg(
        F.max(F.when(F.col("starts") & (F.col("kind") == "item"), F.col("number"))).alias("number"), F.max(F.coalesce("section", F.lit(fallback))).alias("section"), F.max(F.when(F.col("starts"), title)).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(prose, F.struct("n", "line")))), lambda x: x["line"]), "\n\n").alias("body"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.col("n"))).alias("source"), F.max_by("quote", F.when(F.col("quote").isNotNull(), F.col("n"))).alias("quote"), F.min_by(dated, F.when(dated.isNotNull(), F.col("n"))).alias("published"),
    )
    return out.withColumn("number", F.coalesce("number", F.col("item").cast("int")))


def draft_warnings(placed: DataFrame) -> DataFrame:
    """Lines that no item takes: doc, n, warning, line (its first 30 characters)."""
    left = placed.filter("item is null and kind in ('field', 'prose')")
    return left.select("doc", "n", F.when(F.col("kind") == "field", "field_without_item").otherwise("prose_without_item").alias("warning"), F.substring("line", 1, 30).alias("line"))
