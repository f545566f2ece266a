"""The tables as the engine sees them. Articles are documents with the columns that a collection run adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("economy", "energy", "culture", "sports", "finance")

#: The same view in DuckDB SQL, as the first of a query's common table expressions.
ARTICLES_SQL = """articles as (
  select doc_id as id, trim(split_part(coalesce(text, ''), chr(10), 1)) as title, coalesce(text, '') as content, lang as country, source,
    ['economy', 'energy', 'culture', 'sports', 'finance'][doc_id % 5 + 1] as category,
    timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id * 37 % 43200 as integer)) as published_at,
    'https://' || case when doc_id % 3 = 0 then 'www.' else '' end || 'news' || doc_id % 40 || '.example.org/story/' || doc_id % 900 ||
      case doc_id % 4 when 0 then '/' when 1 then '?utm_source=feed&b=2&a=1' when 2 then '#top' else '' end as url
  from documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(table(spark, sf_dir, "documents"))


def as_articles(documents: DataFrame) -> DataFrame:
    """Batches or streams of documents with the columns that a collection run adds."""
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    return documents.select(
        F.col("doc_id").alias("id"),
        F.expr("trim(split_part(coalesce(text, ''), '\\n', 1))").alias("title"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("lang").alias("country"),
        "source",
        F.expr(f"element_at(array({names}), cast(doc_id % 5 + 1 as int))").alias("category"),
        F.expr("timestampadd(MINUTE, doc_id * 37 % 43200, timestamp_ntz'2024-01-01 00:00:00')").alias("published_at"),
        F.expr("'https://' || case when doc_id % 3 = 0 then 'www.' else '' end || 'news' || doc_id % 40 || '.example.org/story/' || doc_id % 900 || case doc_id % 4 when 0 then '/' when 1 then '?utm_source=feed&b=2&a=1' when 2 then '#top' else '' end").alias("url"),
    )
