"""Funnels, coverage and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import GATED_SQL, TOPIC_WORDS, _score_sql, gated, identity_keys, keyword_score
from .joins import KEYED_SQL
from .registry import query

_REASONS = ("junk", "no_body", "country", "topic", "category")


@query(f"with {GATED_SQL} select country, source, count(*) as fetched, count(*) filter (where reason is null) as kept, " + ", ".join(f"count(*) filter (where reason = '{r}') as dropped_{r}" for r in _REASONS) + " from gated group by grouping sets ((country, source), (country), ())")
def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, 02, 03, EV-16: the funnel by source, by country and in all, in one pass."""
    counters = [F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("reason").isNull()).alias("kept"), *(F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in _REASONS)]
    rows = gated(spark, sf_dir)
    return rows.groupingSets([["country", "source"], ["country"], []], "country", "source").agg(*counters).select("country", "source", "fetched", "kept", *(f"dropped_{r}" for r in _REASONS))


@query(f"with {GATED_SQL} select country, reason, count(*) as n, min(id) as first_id, max(id) as last_id from gated where reason is not null group by rollup (country, reason)")
def agg_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, AGG-07: drops by country and reason with subtotals, and the ends of their ids as samples."""
    return gated(spark, sf_dir).filter("reason is not null").rollup("country", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"with {KEYED_SQL}, u as (select *, min(id) over (partition by url_key) as first_url from keyed), left_over as (select * from u where id = first_url and title_key != '') select 'url' as kind, min(id) as keep, count(*) as n from keyed group by url_key having count(*) > 1 union all select 'title', min(id), count(*) from left_over group by title_key having count(*) > 1")
def agg_identical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, SRC-19, SRC-20: groups with one address, then groups with one title among those that are left."""
    rows = identity_keys(articles(spark, sf_dir))
    by_url = rows.groupBy("url_key").agg(F.min_by("title_key", "id").alias("title_key"), F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    by_title = by_url.filter("title_key != ''").groupBy("title_key").agg(F.min("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    return by_url.filter("n > 1").select(F.lit("url").alias("kind"), "keep", "n").union(by_title.filter("n > 1").select(F.lit("title"), "keep", "n"))


@query("select r_name, n_name, count(o_orderkey) as n from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey and o_orderdate between timestamp '1995-03-01 00:00:00' and timestamp '1995-03-01 23:59:59' group by all")
def agg_daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, SRC-17: counts of a closed day for every member of a dimension, zero rows kept."""
    day = table(spark, sf_dir, "orders").filter("o_orderdate between timestamp_ntz'1995-03-01 00:00:00' and timestamp_ntz'1995-03-01 23:59:59'").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("found"))
    all_rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.expr("n_regionkey = r_regionkey"))
    return all_rows.join(day, F.expr("c_nationkey = n_nationkey"), "left").select("r_name", "n_name", F.coalesce("found", F.lit(0)).alias("n"))


@query(f"with {ARTICLES_SQL} select id, 3 * {_score_sql('title')} + {_score_sql('content')} as score from articles")
def agg_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: words of a title count three times those of a text; how often a word occurs doesn't matter."""
    return articles(spark, sf_dir).select("id", (3 * keyword_score(F.col("title"), TOPIC_WORDS) + keyword_score(F.col("content"), TOPIC_WORDS)).alias("score"))


@query("select user_id, count(*) as scans, count(*) filter (where event_type = 'error') as failed, strftime(max(ts) filter (where event_type = 'view'), '%Y-%m-%d %H:%M:%S') as last_view, max(event_id) filter (where event_type = 'click') as last_click, bool_or(ts >= timestamp '2024-01-28 00:00:00') as after_cutoff, sum(value) filter (where event_type = 'purchase') is not null as bought from events group by all")
def agg_source_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-18, AGG-19, AGG-20: counters and latest observations of each source."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(F.col("event_type") == "error").alias("failed"), F.date_format(F.max(F.when(F.col("event_type") == "view", F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_view"),
        F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("last_click"), F.bool_or(F.expr("ts >= timestamp_ntz'2024-01-28 00:00:00'")).alias("after_cutoff"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).isNotNull().alias("bought"),
    )


@query("select n_name, count(distinct c_mktsegment) as families, count(distinct case when c_acctbal > 5000 then c_mktsegment end) as with_text, count(distinct c_mktsegment) >= 5 and count(distinct case when c_acctbal > 5000 then c_mktsegment end) >= 3 as covered from customer join nation on c_nationkey = n_nationkey group by all")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, AGG-13, AGG-14, VAL-12: distinct families attempted and read, held against thresholds."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    counts = rows.groupBy("n_name").agg(F.countDistinct("c_mktsegment").alias("families"), F.countDistinct(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("with_text"))
    return counts.withColumn("covered", F.expr("families >= 5 and with_text >= 3"))


@query("with latest as (select l_suppkey, l_partkey, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) as flag from lineitem group by all) select l_suppkey, count(*) as entries, bool_and(flag = 'N') as unavailable from latest group by all")
def agg_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: a source is out iff the latest answer of each of its entries is terminal."""
    latest = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("flag"))
    return latest.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("entries"), F.bool_and(F.col("flag") == "N").alias("unavailable"))


@query("select p_partkey, p_brand, p_size, count(*) over (partition by p_brand, p_size, p_type) > 1 as reused from part")
def agg_reused_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, VAL-09: values that are used more than once."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    used = parts.groupBy("p_brand", "p_size", "p_type").agg(F.count(F.lit(1)).alias("n"))  # combines before the shuffle
    return parts.join(used, ["p_brand", "p_size", "p_type"]).select("p_partkey", "p_brand", "p_size", (F.col("n") > 1).alias("reused"))


@query("with r as (select user_id, cast(ts as date) as day, count(*) as n from events group by all) select user_id, round(avg(n), 9) as mean, round(stddev_samp(n), 9) as sd, max(n) - min(n) as spread, count(*) as runs, round(quantile_cont(n, 0.5), 9) as median from r group by user_id having count(*) >= 2")
def ev_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-05, EV-07, EV-13, EV-17: mean, sample deviation, spread and median of what ran twice at least."""
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_samp("n"), 9).alias("sd"), (F.max("n") - F.min("n")).alias("spread"), F.count(F.lit(1)).alias("runs"), F.round(F.percentile("n", 0.5), 9).alias("median")).filter("runs >= 2")


@query(f"with {ARTICLES_SQL}, w as (select id, country, unnest(['der', 'the', 'que', 'les', 'zzz']) as word, content from articles) select word, country, count(*) filter (where contains(lower(content), word)) as hits, count(*) as n from w group by all")
def ev_keyword_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-10, EV-11: how many rows each word finds by country; dead words show zero."""
    words = ["der", "the", "que", "les", "zzz"]
    rows = articles(spark, sf_dir).select("country", F.lower("content").alias("low"))
    flagged = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.contains("low", F.lit(w))).alias(w) for w in words))
    return flagged.select("country", "n", F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(w).alias("hits")) for w in words))).alias("x")).select("x.word", "country", "x.hits", "n")
