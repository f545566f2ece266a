"""Rules as a table with the time from which each version holds: added, changed or ended without code.

A rule is a row (rule, version, kind, field, value, scope, effective_from, severity). Kinds: missing, shorter and longer (than a
number of characters), matches and lacks (a pattern), holds and wants (a word, in lower case), differs (from another field),
retired (the rule ends). Of a rule's versions the last one that is effective at a row's time counts, an as-of choice made once
on the rule table. Rules of all kinds but words become one ordered expression, in which a pattern is compiled once; words go
through the keyword join, so that thousands of them leave the plan as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocabulary import keyword_hits

RULES = "rule string, version int, kind string, field string, value string, scope string, effective_from date, severity int"
#: Rules of other kinds than words that one expression takes.
MOST = 2000
WORD_KINDS = ("holds", "wants")


def periods(rules: DataFrame) -> DataFrame:
    """rules with effective_to: the day on which the rule's next version takes over, null for the last one."""
    after = F.lead("effective_from").over(Window.partitionBy("rule").orderBy("effective_from", "version"))
    return rules.withColumn("effective_to", after).filter("effective_to is null or effective_to > effective_from").filter("kind != 'retired'")


def _broken(kind: str, text: Column, value: str | None) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    if kind == "missing":
        return F.trim(text) == ""
    if kind == "shorter":
        return F.length(text) < int(value)
    if kind == "longer":
        return F.length(text) > int(value)
    if kind == "matches":
        return text.rlike(value)
    if kind == "lacks":
        return ~text.rlike(value)
    if kind == "differs":
        return ~F.coalesce(text == F.col(value).cast("string"), F.lit(False))
    raise ValueError(f"unknown kind of rule: {kind}")


def broken_rules(rows: DataFrame, rules: DataFrame, key: str, at: str, scope: str) -> DataFrame:
    """A row for each rule that a row of rows breaks: key, rule, version, severity. key: a whole number that names a row; at: its
    date; scope: the column that a rule's scope must equal (a null scope holds for all). Rows without a date break no rule."""
    known = periods(rules)
    fixed = known.filter(~F.col("kind").isin(*WORD_KINDS)).orderBy("rule", "effective_from").limit(MOST + 1).collect()
    if len(fixed) > MOST:
        raise ValueError(f"more than {MOST} rules that aren't words")

    def told(r) -> Column:
        holds = (F.col(at) >= F.lit(r.effective_from)) & (F.lit(True) if r.effective_to is None else F.col(at) < F.lit(r.effective_to)) & (F.lit(True) if r.scope is None else F.col(scope).eqNullSafe(F.lit(r.scope)))
        return F.when(holds & _broken(r.kind, F.col(r.field), r.value), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.severity).alias("severity")))

    out = rows.select(key, F.explode(F.array_compact(F.array(*map(told, fixed)))).alias("r")).select(key, "r.*") if fixed else rows.select(key, F.lit("").alias("rule"), F.lit(0).alias("version"), F.lit(0).alias("severity")).limit(0)
    worded = known.filter(F.col("kind").isin(*WORD_KINDS)).withColumn("keyword", F.lower("value"))
    for field in [r[0] for r in worded.select("field").distinct().orderBy("field").collect()]:
        mine = worded.filter(F.col("field") == field)
        hits = keyword_hits(rows.select(F.col(key).alias("id"), F.col(field).cast("string").alias("text")), mine).withColumnRenamed("id", key)
        dated = rows.select(key, F.col(at).alias("_at"), F.col(scope).cast("string").alias("_scope"))
        holds = F.expr("_at >= effective_from and (effective_to is null or _at < effective_to) and (scope is null or scope = _scope)")
        held = dated.join(hits, key).join(mine.filter("kind = 'holds'"), "keyword").filter(holds).select(key, "rule", "version", "severity")
        # a wanted word asks every row of its scope and time: the rules are few and joined as they are, the hits take rows out
        wants = mine.filter("kind = 'wants'")
        asked = dated.join(wants, holds).select(key, "keyword", "rule", "version", "severity")
        out = out.union(held).union(asked.join(hits, [key, "keyword"], "left_anti").select(key, "rule", "version", "severity"))
    return out


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def first_broken(broken: DataFrame, key: str) -> DataFrame:
    """Each row's gravest broken rule: key, rule, broken; ties go to the rule's name."""
    return broken.groupBy(key).agg(F.min_by("rule", F.struct(-F.col("severity"), F.col("rule"))).alias("rule"), F.count(F.lit(1)).alias("broken"))
