"""Longest-prefix joins: a path meets the registered prefixes by equality with its own prefixes, of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """A path's segments; a slash at either end or a doubled one makes none."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def prefixes(path: Column) -> Column:
    """All prefixes of a path at its segments, the empty one first: '', '/a', '/a/b'."""
    each = lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda n: F.concat(F.when(n > 0, "/").otherwise(""), F.array_join(F.slice(s, 1, n), "/")))
    return F.get(F.transform(F.array(segments(path)), each), F.lit(0))


def longest_prefix(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (id, host, path), known (host, prefix, name) -> id, prefix, name for every row of asked.

    The longest prefix of the path's segments that is registered for the host; null where there is none, and a null name where
    several names share it. known has a row a host and prefix when it is joined, so a host that most rows have can be split.
    """
    one = known.filter("name is not null").select("host", F.concat_ws("/", F.array(F.lit("")), segments(F.col("prefix"))).alias("prefix"), "name")
    one = one.groupBy("host", "prefix").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    own = asked.select("id", "host", F.explode(prefixes(F.col("path"))).alias("prefix"))
    best = own.join(one, ["host", "prefix"]).groupBy("id").agg(F.max_by(F.struct("prefix", "low", "high"), F.length("prefix")).alias("b"))
    return asked.select("id").join(best, "id", "left").select("id", F.col("b.prefix").alias("prefix"), F.when(F.col("b.low") == F.col("b.high"), F.col("b.low")).alias("name"))


def explained_languages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (id, host, path, declared, wanted, at), rules (rule, host, prefixes, excluded, declared, content, reviewed_at,
    evidence_at, status) -> id, rule, language, verified, matches.

    A wrong language tag is explained by the least verified rule for its host with that tag, whose content language is wanted and
    isn't the tag's own, one of whose path prefixes the path is under, none of whose excluded ones it is under, and whose
    review isn't later than the page and follows its evidence. An explained tag is kept apart: it verifies no language."""
    base = lambda c: F.split_part(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    asked = pages.select("id", "host", "declared", "wanted", "at", F.explode(prefixes(F.col("path"))).alias("prefix"))
    usable = rules.filter("status = 'verified' and size(prefixes) > 0 and reviewed_at is not null and evidence_at <= reviewed_at")
    normal = lambda c: F.transform(c, lambda p: F.concat_ws("/", F.array(F.lit("")), segments(p)))
    listed = lambda c: usable.select("rule", "host", F.col("declared").alias("tag"), "content", "reviewed_at", F.explode(F.array_distinct(normal(c))).alias("prefix"))
    met = asked.join(listed(F.col("prefixes")), ["host", "prefix"])
    fits = (F.lower("tag") == F.lower("declared")) & (base(F.col("content")) == base(F.col("wanted"))) & (base(F.col("content")) != base(F.col("declared"))) & (F.col("reviewed_at") <= F.col("at"))
    barred = asked.join(listed(F.col("excluded")), ["host", "prefix"]).select("id", "rule").distinct()
    chosen = met.filter(fits).select("id", "rule").distinct().join(barred, ["id", "rule"], "left_anti").groupBy("id").agg(F.min("rule").alias("rule"))
    same = base(F.col("declared")) == base(F.col("wanted"))
    out = pages.join(chosen, "id", "left")
    return out.select("id", "rule", F.when(F.col("rule").isNull(), base(F.col("declared"))).alias("language"), (F.col("rule").isNull() & F.coalesce(same, F.lit(False))).alias("verified"), F.when(F.col("rule").isNotNull(), False).otherwise(same).alias("matches"))
