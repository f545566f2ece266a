"""Scans, writes and the rules on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ARTICLES_SQL, articles, table
from .registry import query

def channel_rows(settings: DataFrame) -> DataFrame:
    """settings (setting: 'kz:@a@b, uz:@c', malformed parts are left out) -> country, channel."""
    part = settings.select(F.explode(F.split("setting", ",")).alias("part"))
    return part.select(F.trim(F.split_part("part", F.lit(":"), F.lit(1))).alias("country"), F.explode(F.regexp_extract_all(F.split_part("part", F.lit(":"), F.lit(2)), F.lit("@([a-z0-9_]+)"), F.lit(1))).alias("channel"))


@query("select lower(n_name) as country, unnest(['ch' || n_nationkey, 'news_' || n_regionkey]) as channel from nation")
def src_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: channel settings as rows. A setting for each region is put together here."""
    one = F.concat(F.lower("n_name"), F.lit(":@ch"), F.col("n_nationkey").cast("string"), F.lit("@news_"), F.col("n_regionkey").cast("string"))
    settings = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array_join(F.collect_list(one), ", "), F.lit(", bad")).alias("setting"))
    return channel_rows(settings)


@query("select d.doc_id, case when length(coalesce(d.text, '')) < 60 then 'page' else 'feed' end as via, case when length(coalesce(d.text, '')) < 60 then length(p.html) else length(d.text) end as n from documents d left join pages p on p.page_id = d.doc_id")
def src_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, FLT-08: a short text is taken from its page; null where there is none."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("page_chars"))
    n = F.length(F.coalesce("text", F.lit("")))
    return docs.join(pages, F.expr("page_id = doc_id"), "left").select("doc_id", F.when(n < 60, "page").otherwise("feed").alias("via"), F.when(n < 60, F.col("page_chars")).otherwise(n).cast("long").alias("n"))


@query("select distinct o_orderpriority, o_orderstatus from orders where o_orderpriority like '1-U%' and o_orderstatus in ('F', 'O')")
def src_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: rows by prefix and state."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").like("1-U%") & F.col("o_orderstatus").isin("F", "O")).select("o_orderpriority", "o_orderstatus").distinct()


@query(f"with {ARTICLES_SQL} select coalesce(country, 'intl') as country, count(*) as titles, min(id) as first_id from articles where published_at >= timestamp '2024-01-20 00:00:00' and title not in ('', 'untitled') group by all")
def src_recent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: recent titles by country."""
    rows = articles(spark, sf_dir).filter("published_at >= timestamp_ntz'2024-01-20 00:00:00' and title not in ('', 'untitled')")
    return rows.groupBy(F.coalesce("country", F.lit("intl")).alias("country")).agg(F.count(F.lit(1)).alias("titles"), F.min("id").alias("first_id"))


@query("select event_id, sha256(concat_ws('|', user_id, event_type, props)) as event_key, row_number() over (partition by user_id, event_type, props order by event_id) = 1 as stored from events")
def snk_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09, STM-06: an event's id is the hash of what it says, and an event is stored once."""
    key = F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256)
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("first_id")).select("first_id")
    return events.join(first, F.col("event_id") == F.col("first_id"), "left").select("event_id", key.alias("event_key"), F.col("first_id").isNotNull().alias("stored"))


@query(f"with {ARTICLES_SQL} select id, case when title = '' then 'no_title' when country is null then 'no_country' end as error from articles")
def snk_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02: rows that may be written and rows that are set aside, with the reason."""
    return articles(spark, sf_dir).select("id", F.when(F.col("title") == "", "no_title").when(F.col("country").isNull(), "no_country").alias("error"))


@query("with old as (select p_partkey as k, md5(p_name) as h from part where p_partkey % 3 != 0), new as (select p_partkey as k, md5(case when p_partkey % 5 = 0 then p_type else p_name end) as h from part) select k, case when old.h is null then 'inserted' when old.h = new.h then 'duplicate' else 'conflict' end as outcome from new left join old using (k)")
def snk_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, SNK-07, EVD-07: insert if absent; the same hash is a duplicate, another one a conflict."""
    parts = table(spark, sf_dir, "part")
    old = parts.filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("old"))
    new = parts.select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("new"))
    return new.join(old, "k", "left").select("k", F.when(F.col("old").isNull(), "inserted").when(F.expr("old = new"), "duplicate").otherwise("conflict").alias("outcome"))


@query("select conv_id, string_agg('<section><h3>' || role || '</h3><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p></section>', '' order by turn) as html from conversations group by conv_id")
def snk_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, EVD-25: a page from rows in order."""
    part = F.format_string("<section><h3>%s</h3><p>%s</p></section>", "role", F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return rows.select("conv_id", F.array_join(F.col("parts.part"), "").alias("html"))
