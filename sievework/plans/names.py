"""Names in texts held against tables that are learned from the texts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import names as N
from ..sources.shared import stage
from ..sources.tables import ARTICLES_SQL, articles
from .registry import query

_STEM, _RARE = 6, 3
_WORDS = "[a-zà-ÿ]{8,}"
#: Spellings of a country that share a beginning: the one of most texts is right, those of at most _RARE texts are wrong.
_VARIANTS_SQL = f"""{ARTICLES_SQL}, words as (select distinct id, country, unnest(regexp_extract_all(lower(content), '{_WORDS}')) as word from articles where country is not null),
counts as (select country, word, substr(word, 1, {_STEM}) as stem, count(*) as n from words group by all),
best as (select country, stem, arg_max(word, (n, word)) as good, max(n) as most from counts group by all),
variants as (select word as wrong, good, country as scope from counts join best using (country, stem) where word != good and n <= {_RARE} and most > 2 * {_RARE} and contains(good, substr(word, 1, {_STEM + 1})))"""


def _variants(rows: DataFrame) -> DataFrame:
    words = rows.filter("country is not null").select("id", "country", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(_WORDS), F.lit(0)))).alias("word"))
    counts = words.groupBy("country", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", F.substring("word", 1, _STEM))
    best = counts.groupBy("country", "stem").agg(F.max_by("word", F.struct("n", "word")).alias("good"), F.max("n").alias("most"))
    met = counts.join(best, ["country", "stem"]).filter((F.col("word") != F.col("good")) & (F.col("n") <= _RARE) & (F.col("most") > 2 * _RARE) & F.contains("good", F.substring("word", 1, _STEM + 1)))
    return met.select(F.col("word").alias("wrong"), "good", F.col("country").alias("scope"))


@query(f"with {_VARIANTS_SQL} select id, wrong, good from articles join variants on scope = country and contains(lower(content), wrong)")
def val_name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-03: wrong names by a table of thousands of spellings, each for its country, in whole texts."""
    rows = articles(spark, sf_dir)
    return N.wrong_names(rows.select("id", "country", F.col("content").alias("text")), _variants(rows))


_ORGANISATIONS = 100
#: The commonest words of three letters are short forms; the commonest long words are their names, in the same order.
_ORGS_SQL = f"""{ARTICLES_SQL}, seen as (select distinct id, unnest(regexp_extract_all(lower(content), '[a-zà-ÿ]+')) as word from articles), counts as (select word, length(word) = 3 as brief, count(*) as n from seen where length(word) = 3 or length(word) >= 8 group by all),
ranked as (select word, brief, row_number() over (partition by brief order by n desc, word) as r from counts), orgs as (select s.word as short, l.word as name from ranked s join ranked l using (r) where s.brief and not l.brief and r <= {_ORGANISATIONS}),
words as (select distinct id, short from (select id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as short from articles) join orgs using (short)),
named as (select id, short, name from articles join orgs on contains(lower(content), name))"""


@query(f"with {_ORGS_SQL}, strangers as (select id, min(name) as wrong from named n where not exists (select 1 from words w where w.id = n.id and w.short = n.short) group by id) select id, short, wrong from words w join strangers using (id) where not exists (select 1 from named n where n.id = w.id and n.short = w.short)")
def val_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-28: titles that have an organisation's short form over texts that name other ones but not that one."""
    rows = articles(spark, sf_dir)
    words = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-zà-ÿ]+"), F.lit(0)))).alias("word")).filter("length(word) = 3 or length(word) >= 8")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # the table is the commonest words alone, so they are few when they are put in order
    top = lambda test, name: counts.filter(test).orderBy(F.desc("n"), "word").limit(_ORGANISATIONS).select(F.col("word").alias(name), F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("r"))
    orgs = top("length(word) = 3", "short").join(top("length(word) >= 8", "name"), "r")
    return N.organisation_conflicts(rows.select("id", F.lower("title").alias("original"), F.col("content").alias("rendered")), orgs)


@query()
def val_office_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-04: a state's name and an office followed by no bearer's name, by tables learned from the texts: a country's commonest
    word of three words in a row is the state, the second one the office, and the commonest third ones are the bearers.

    SQL has no pattern made of a table's rows: a test holds the operator against a loop over the text."""
    rows = articles(spark, sf_dir).select("id", "country", F.col("content").alias("text"))
    triples = rows.filter("country is not null").select("country", F.explode(F.regexp_extract_all("text", F.lit(r"(?=\b(\p{L}+ \p{L}+ \p{L}+)\b)\b\p{L}"), F.lit(1))).alias("w")).select("country", *(F.split_part("w", F.lit(" "), F.lit(k)).alias(f"w{k}") for k in (1, 2, 3)))
    counts = stage(triples.groupBy("country", "w1", "w2", "w3").agg(F.count(F.lit(1)).alias("n")), "triples")
    states = counts.groupBy("country", "w1", "w2").agg(F.sum("n").alias("n")).groupBy("country").agg(F.max_by(F.struct("w1", "w2"), F.struct("n", "w1", "w2")).alias("s")).select(F.col("country").alias("code"), F.col("s.w1").alias("word"), F.col("s.w2").alias("office"))
    states = stage(states, "states")
    thirds = counts.join(states, F.expr("country = code and w1 = word and w2 = office")).groupBy("code").agg(F.max_by("w3", F.struct("n", "w3")).alias("form"))
    offices = sorted(r[0] for r in states.select("office").distinct().collect())  # one for each country
    if not offices:
        return rows.select("id", F.lit("").alias("code"), F.lit("").alias("sample")).limit(0)
    return N.other_bearers(rows.select("id", "text"), offices, states.select("word", "code"), thirds.select("form"), r"\p{L}+")
