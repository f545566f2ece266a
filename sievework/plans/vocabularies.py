"""Gates, tags, scores and audits by keyword tables of any size. The table is learned from the articles themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vocabulary import keyword_hits, relevance, scored, word_table
from ..sources.shared import stage
from ..sources.tables import ARTICLES_SQL, CATEGORIES, articles
from .registry import query

HOME = ["de", "en", "fr"]
_HOME_SQL = ", ".join(f"'{c}'" for c in HOME)
_BEST_SQL = "select keyword, arg_max({c}, (n, {c})) as {c}, count(*) as n_{c}, sum(n) as rows_{c} from (select keyword, {c}, sum(n) as n from counts group by all) group by keyword"
VOCABULARY_SQL = f"""{ARTICLES_SQL}, counts as (
  select keyword, country, category, count(*) as n from (select distinct id, country, category, unnest(regexp_extract_all(lower(content), '[a-zà-ÿ]{{4,}}')) as keyword from articles where country is not null) group by all
), vocabulary as (
  select keyword, case when n_country < 3 and country in ({_HOME_SQL}) then country end as country, case when rows_country >= 4 then 'push' else 'ingest' end as side,
    case when n_country >= 3 then 'region' when country in ({_HOME_SQL}) then 'country' else 'foreign' end as kind, category, case when length(keyword) >= 9 then 3 when length(keyword) >= 6 then 2 else 1 end as weight
  from ({_BEST_SQL.format(c="country")}) join ({_BEST_SQL.format(c="category")}) using (keyword) where rows_country >= 2
), hits as (select id, keyword from articles, vocabulary where contains(lower(title), keyword))"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(articles(spark, sf_dir).filter("country is not null"), HOME)


def _title_hits(rows: DataFrame, words: DataFrame, *carry: str) -> DataFrame:
    return keyword_hits(rows.select("id", F.col("title").alias("text")), words, carry=carry)


@query(f"with {VOCABULARY_SQL} select keyword, country, side, kind, category, weight from vocabulary")
def prj_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: the keyword table by country, side and kind, with categories and weights."""
    return vocabulary(spark, sf_dir)


_ROWS_SQL = "rows as (select id, country, case when id % 3 = 0 then null when id % 7 = 0 then 'intl' when id % 5 = 0 then 'fr' else country end as source_country from articles)"
_RULE_SQL = f"""{_ROWS_SQL}, told as (
  select id, bool_or(kind = 'country' and v.country = r.country) as own, bool_or(kind = 'region') as region, bool_or(kind = 'country' and v.country != r.country) as other, bool_or(kind = 'foreign') as "foreign"
  from rows r join hits using (id) join vocabulary v using (keyword) where source_country is not null or side = 'push' group by id
), ruled as (select r.*, case when own then 'own' when region then 'region' when other then 'other' when "foreign" then 'foreign' when source_country is null then 'push' else 'source' end as rule from rows r left join told using (id))"""


@query(f"with {VOCABULARY_SQL}, {_RULE_SQL} select id, case when rule in ('own', 'region', 'push') then true when rule in ('other', 'foreign') then false else source_country = country and source_country != 'intl' end as relevant, rule from ruled")
def flt_relevant_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02, FLT-03, VAL-03: whether a row is its country's, by the first rule of the keyword table that decides."""
    rows, words = articles(spark, sf_dir), vocabulary(spark, sf_dir)
    asked = rows.select("id", "country", F.expr("case when id % 3 = 0 then null when id % 7 = 0 then 'intl' when id % 5 = 0 then 'fr' else country end").alias("source_country"))
    return relevance(asked, _title_hits(rows, words, "country", "side", "kind"), words)


_ORDER_SQL = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


@query(f"""with {VOCABULARY_SQL}, tagged as (select id, category, count(*) as n from hits join vocabulary using (keyword) group by all),
tags as (select id, string_agg(category, ',' order by list_position({_ORDER_SQL}, category)) as tags, arg_min(category, list_position({_ORDER_SQL}, category)) as first from tagged group by id),
places as (select id, arg_max(country, (n, -list_position([{_HOME_SQL}], country))) as place from (select id, v.country, count(*) as n from hits join vocabulary v using (keyword) where kind = 'country' group by all) group by id)
select id, coalesce(tags, 'general') as tags, coalesce(first, 'economy') as category, place from articles left join tags using (id) left join places using (id)""")
def prj_labels_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, PRJ-06, PRJ-07: a row's tags, the first category in the list's order, and the country with most entries (the first one of equals)."""
    rows, words = articles(spark, sf_dir), vocabulary(spark, sf_dir)
    hits = _title_hits(rows, words, "country", "kind", "category").groupBy("id", "country", "kind", "category").agg(F.count(F.lit(1)).alias("n"))
    hits = stage(hits, "hits")
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    tags = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(order.alias("at"), "category"))).alias("t"))
    counts = hits.filter("kind = 'country'").groupBy("id", "country").agg(F.sum("n").alias("n"))
    places = counts.groupBy("id").agg(F.max_by("country", F.struct("n", -F.array_position(F.array(*map(F.lit, HOME)), F.col("country")))).alias("place"))
    met = rows.select("id").join(tags, "id", "left").join(places, "id", "left")
    return met.select("id", F.coalesce(F.array_join(F.transform("t", lambda x: x["category"]), ","), F.lit("general")).alias("tags"), F.coalesce(F.get("t", F.lit(0))["category"], F.lit("economy")).alias("category"), "place")


@query(f"""with {VOCABULARY_SQL}, lines as (select id, trim(split_part(content, chr(10), 2)) as summary from articles), below as (select id, keyword from lines, vocabulary where contains(lower(summary), keyword)),
whole as (select id, 3 * weight as w from hits join vocabulary using (keyword) union all select id, weight from below join vocabulary using (keyword))
select id, cast(coalesce(sum(w), 0) as bigint) as score, count(w) as n_hits from articles left join whole using (id) group by id""")
def agg_score_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: the weights of the entries in the title, three times, and in the line below it; how often doesn't count."""
    rows, words = articles(spark, sf_dir), vocabulary(spark, sf_dir)
    title = scored(_title_hits(rows, words, "weight"), words)
    below = scored(keyword_hits(rows.select("id", F.expr("trim(split_part(content, '\\n', 2))").alias("text")), words, carry=["weight"]), words)
    both = title.select("id", (3 * F.col("score")).alias("score"), "hits").union(below.select("id", "score", "hits")).groupBy("id").agg(F.sum("score").alias("score"), F.sum("hits").alias("hits"))
    return rows.select("id").join(both, "id", "left").select("id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("hits", F.lit(0)).alias("n_hits"))


@query(f"with {VOCABULARY_SQL} select keyword, country, count(id) as n_hits, count(id) = 0 as dead from vocabulary left join hits using (keyword) group by keyword, country")
def ev_vocabulary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-10: how many titles each entry hits, and the dead ones."""
    rows, words = articles(spark, sf_dir), vocabulary(spark, sf_dir)
    counts = _title_hits(rows, words).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, "keyword", "left").select("keyword", "country", F.coalesce("n", F.lit(0)).alias("n_hits"), F.col("n").isNull().alias("dead"))
