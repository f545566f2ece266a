"""Names by tables of any size: wrong names, names after an office that isn't its bearer's, and organisations that a rendering
takes for others.

Texts meet the tables through the keyword join, or through the pieces around a place where a name may stand, so that no name is in
the plan. Null texts hold nothing; null and empty names are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import keyword_hits

#: Characters before a name in which an office or a state may stand; longer names of either can't be met.
BEFORE = 24
#: A name after an office: words that begin with a capital, or two short runs of signs of a script without cases, parted by a dot.
NAME = r"\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*){0,3}|\p{Lo}{2,5}[·•‧]\p{Lo}{2,8}"


def wrong_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (id, country, text), names (wrong, good, scope) -> (id, wrong, good): wrong names that a text holds, whatever their
    case, if they are wrong everywhere (no scope) or in the row's country."""
    table = names.filter("wrong is not null and wrong != ''").select(F.lower("wrong").alias("keyword"), "wrong", "good", "scope").distinct()
    hits = keyword_hits(rows.select("id", "text"), table)
    met = hits.join(table, "keyword").join(rows.select("id", "country"), "id")
    return met.filter("scope is null or scope = country").select("id", "wrong", "good")


def _suffixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.substr(text, k))


def foreign_spellings(rows: DataFrame, forms: DataFrame, contexts: DataFrame) -> DataFrame:
    """rows (id, text), forms (form, code), contexts (word) -> (id, code, form): a form stands right behind an office or a state's
    name (spaces or a dot may part them) and no letter follows. Of a code's forms the least one is told."""
    known = forms.filter("form != ''").distinct()
    held = keyword_hits(rows.select("id", "text"), known.select(F.col("form").alias("keyword")))
    met = held.join(known.withColumn("keyword", F.lower("form")), "keyword").select("id", "form", "code").join(rows.select("id", "text"), "id")
    pieces = met.withColumn("p", F.split("text", F.concat(F.lit("\\Q"), "form", F.lit("\\E"))))
    # a form may stand right behind or before another time that it stands there
    left = lambda k: F.concat(F.when(k > 1, F.col("form")).otherwise(F.lit("")), F.get("p", k - 1))
    right = lambda k: F.concat(F.get("p", k), F.when(k < F.size("p") - 1, F.col("form")).otherwise(F.lit("")))
    around = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.right(F.rtrim(left(k), F.lit(" ·•")), F.lit(BEFORE)).alias("before"), F.substr(right(k), F.lit(1), F.lit(1)).alias("after")))
    spots = pieces.filter(F.size("p") > 1).select("id", "form", "code", F.explode(around).alias("a")).filter(~F.col("a.after").rlike(r"\p{L}")).select("id", "form", "code", F.explode(F.array_distinct(_suffixes(F.col("a.before")))).alias("word"))
    return spots.join(contexts.select("word").distinct(), "word", "left_semi").groupBy("id", "code").agg(F.min("form").alias("form"))


def other_bearers(rows: DataFrame, offices: list[str], states: DataFrame, bearers: DataFrame, name: str = NAME) -> DataFrame:
    """rows (id, text), states (word, code), bearers (form) -> (id, code, sample): a state's name, an office, and then a name that
    begins with no bearer's form, so that words which a script without spaces adds behind a right name don't count. offices: a
    short list, part of the pattern. The first such place of a text counts for each state."""
    if not offices:
        raise ValueError("no offices")
    quoted = "|".join(rf"\Q{o}\E" for o in sorted(offices, key=len, reverse=True))
    pattern = rf"(?:{quoted})\s{{0,3}}({name})"
    # what stands between one place and the next one is what stands before the latter
    spots = rows.select("id", F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("samples"), F.split("text", pattern).alias("pieces")).filter(F.size("samples") > 0)
    found = spots.select("id", F.posexplode(F.transform("samples", lambda s, k: F.struct(s.alias("sample"), F.right(F.rtrim(F.get("pieces", k)), F.lit(BEFORE)).alias("before")))).alias("at", "m")).select("id", "at", "m.*")
    placed = found.withColumn("word", F.explode(_suffixes(F.col("before")))).join(states.select("word", "code").distinct(), "word").groupBy("id", "at", "sample").agg(F.max_by("code", F.struct(F.length("word"), "code")).alias("code"))
    forms = bearers.select("form").filter("form != ''").distinct()
    ends = forms.agg(F.min(F.length("form")), F.max(F.length("form"))).first()
    low, high = ends[0] or 1, ends[1] or 1
    starts = placed.filter(F.length("sample") >= low).withColumn("form", F.explode(F.transform(F.sequence(F.lit(low), F.least(F.length("sample"), F.lit(high))), lambda k: F.substr("sample", F.lit(1), k))))
    right = starts.join(forms, "form", "left_semi").select("id", "at").distinct()
    return placed.join(right, ["id", "at"], "left_anti").groupBy("id", "code").agg(F.min_by("sample", "at").alias("sample"))


def organisation_conflicts(rows: DataFrame, organisations: DataFrame) -> DataFrame:
    """rows (id, original, rendered), organisations (short, name) -> (id, short, wrong): the original has an organisation's short
    form as a word, the rendering has none of its names but that of one which the original doesn't have. The least of those is told.
    """
    known = organisations.filter("short != '' and name != ''").distinct()
    shorts = known.select("short").distinct()
    words = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("original", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("short")).join(shorts, "short")
    held = keyword_hits(rows.select("id", F.col("rendered").alias("text")), known.select(F.col("name").alias("keyword")))
    named = held.join(known.withColumn("keyword", F.lower("name")), "keyword").select("id", "short", "name")
    missing = words.join(named.select("id", "short"), ["id", "short"], "left_anti")
    strangers = named.join(words, ["id", "short"], "left_anti").groupBy("id").agg(F.min("name").alias("wrong"))
    return missing.join(strangers, "id").select("id", "short", "wrong")
