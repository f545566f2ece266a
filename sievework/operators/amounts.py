"""Amounts with words of scale, read from texts, and amounts that two texts give in scales that differ by powers of ten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount

#: How far from a whole power of ten a ratio's logarithm may be.
POWER_SLACK = 0.02


def joined_thousands(text: Column) -> Column:
    """A space between a digit and exactly three digits is no separator of numbers: 1 072 is one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)\s(\d{3})(?!\d)", "$1$2")


def scaled_amounts(texts: DataFrame, units: DataFrame) -> DataFrame:
    """texts (id, text), units (word, scale) -> id, nth, raw, digits, value: every number before a word of scale, in order.

    A word of scale may have any ending (million, millions); of several that fit the longest counts. The words are joined by
    equality with the starts of what follows the number, so that a table of any size leaves the plan as it is. Zero and what is
    no number are no amounts."""
    longest = units.agg(F.max(F.length("word"))).first()[0] or 0
    found = F.posexplode(F.regexp_extract_all(joined_thousands(F.col("text")), F.lit(r"\d[\d.,]*\s*\p{L}+"), F.lit(0)))
    rows = texts.select("id", found.alias("nth", "raw")).select("id", "nth", "raw", F.regexp_extract("raw", r"^(\d[\d.,]*)", 1).alias("number"), F.lower(F.regexp_extract("raw", r"(\p{L}+)$", 1)).alias("tail"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("tail"), F.lit(max(1, longest)))), lambda n: F.substr("tail", F.lit(1), n))
    met = rows.withColumn("word", F.explode(starts)).join(units.select(F.lower("word").alias("word"), "scale").groupBy("word").agg(F.max("scale").alias("scale")), "word")
    best = met.groupBy("id", "nth", "raw", "number").agg(F.max_by("scale", F.length("word")).alias("scale"))
    # a full stop that ends a sentence is no part of the number
    value = amount(F.regexp_replace("number", r"[.,]+$", ""))
    return best.select("id", "nth", "raw", F.regexp_replace("number", r"\D", "").alias("digits"), (value * F.col("scale")).alias("value")).filter("value > 0")


def magnitude_mismatches(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """originals, translations (id, nth, raw, digits, value) -> id, raw, closest, ratio: amounts whose nearest one of the other
    side, among those with the same digits or digits that go on, is off by a power of ten.

    An amount without such a partner is left out, as is a text whose other side has no amounts. Partners meet by equality of one
    side's digits with a start of the other's, so two long lists of amounts aren't compared with each other."""
    starts = lambda digits: F.explode(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda n: F.substr(digits, F.lit(1), n))).alias("start")
    one = originals.select("id", F.col("nth").alias("k"), F.col("raw").alias("raw_a"), F.col("digits").alias("digits_a"), F.col("value").alias("a"))
    two = translations.select("id", F.col("nth").alias("m"), F.col("raw").alias("raw_b"), F.col("digits").alias("digits_b"), F.col("value").alias("b"))
    columns = ["id", "k", "raw_a", "a", "m", "raw_b", "b"]
    met = one.withColumn("start", F.col("digits_a")).join(two.select("*", starts("digits_b")), ["id", "start"]).select(columns)
    met = met.union(one.select("*", starts("digits_a")).join(two.withColumn("start", F.col("digits_b")), ["id", "start"]).filter("digits_a != digits_b").select(columns))
    best = met.groupBy("id", "k", "raw_a", "a").agg(F.min_by(F.struct("raw_b", "b"), F.struct(F.abs(F.col("b") - F.col("a")), F.col("m"))).alias("best"))
    power = F.log10(F.col("best.b") / F.col("a"))
    return best.filter((F.abs(power - F.rint(power)) < POWER_SLACK) & (F.rint(power) != 0)).select("id", F.col("raw_a").alias("raw"), F.col("best.raw_b").alias("closest"), (F.col("best.b") / F.col("a")).alias("ratio"))
