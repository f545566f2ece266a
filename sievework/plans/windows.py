"""Window-shaped queries and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import GATED_SQL, TOPIC_WORDS, _score_sql, gated, keyword_score
from .registry import query

PER_COUNTRY, SCREENED = 20, 60
SCORED_SQL = f"{GATED_SQL}, scored as (select *, 3 * {_score_sql('title')} + {_score_sql('content')} + case when contains(content, '<img') then 5 else 0 end as score from gated where reason is null), placed as (select *, row_number() over (partition by country order by score desc, published_at desc, id) as place from scored)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 3 * keyword_score(F.col("title"), TOPIC_WORDS) + keyword_score(F.col("content"), TOPIC_WORDS) + F.when(F.contains("content", F.lit("<img")), 5).otherwise(0)
    scored = gated(spark, sf_dir).filter("reason is null").select("id", "country", "published_at", score.alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("score"), F.desc("published_at"), "id")))


@query(f"with {SCORED_SQL} select country, cast(place as int) as place, id, score from placed where place <= {PER_COUNTRY}")
def top_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01, 02, 04: the best rows of each country. The row-number filter becomes a group limit before the shuffle."""
    return _placed(spark, sf_dir).filter(F.col("place") <= PER_COUNTRY).select("country", "place", "id", "score")


@query(f"with {SCORED_SQL} select country, count(*) as candidates, greatest(count(*) - {SCREENED}, 0) as cut from scored group by country")
def top_cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-03: how many rows a cap leaves out."""
    return gated(spark, sf_dir).filter("reason is null").groupBy("country").agg(F.count(F.lit(1)).alias("candidates")).withColumn("cut", F.greatest(F.col("candidates") - SCREENED, F.lit(0)))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 8")
def top_newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-05, TOP-12: the newest eight of each channel."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(newest)).filter("r <= 8").select("user_id", "event_id")


@query("with m as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r, c_acctbal > 9000 as main, count(*) filter (where c_acctbal > 9000) over (partition by c_nationkey) as mains from customer) select c_nationkey, c_custkey, case when main then 'main' else 'fill' end as kind from m where main or (mains < 10 and r <= 20)")
def top_fill_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-06: groups with fewer than ten rows are filled up with their next best."""
    key = Window.partitionBy("c_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 9000).alias("main"), F.row_number().over(key.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("r"), F.count_if(F.col("c_acctbal") > 9000).over(key).alias("mains"))
    return rows.filter("main or (mains < 10 and r <= 20)").select("c_nationkey", "c_custkey", F.when(F.col("main"), "main").otherwise("fill").alias("kind"))


_PRIORITY = "cast(l_quantity as bigint) + case when l_shipdate >= timestamp '1996-01-01 00:00:00' then 120 else -80 end"


@query(f"select l_orderkey, l_linenumber, {_PRIORITY} as priority from lineitem order by priority desc, l_shipdate, l_orderkey, l_linenumber limit 100")
def top_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-08, TOP-10, SRC-15: the first page of leads by priority."""
    priority = F.col("l_quantity").cast("long") + F.when(F.expr("l_shipdate >= timestamp_ntz'1996-01-01 00:00:00'"), 120).otherwise(-80)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", priority.alias("priority")).orderBy(F.desc("priority"), "l_shipdate", "l_orderkey", "l_linenumber").limit(100).drop("l_shipdate")


@query("select o_custkey, min(o_orderkey) filter (where o_orderpriority like '1%') as cover from orders group by o_custkey")
def top_first_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11: the first row of a group that has what is asked for."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderpriority").like("1%"), F.col("o_orderkey"))).alias("cover"))


@query("select l_partkey, l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) as l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') as shipped from lineitem group by all")
def win_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, WIN-02, SNK-04, EVD-06: the latest row of a key, the later of equals; an aggregation, so it combines early."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("l_orderkey"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("shipped"))


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r from part) select p_brand, p_partkey, cast(r as int) as turn from r")
def win_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: one from each group in turn; sorted by turn and group when it is written."""
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("turn"))


@query("select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r from lineitem) where r = 1")
def win_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: the best row of each item, the first of equals."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("k"))).alias("b"))
    return best.select("l_orderkey", (-F.col("b.k")).alias("l_linenumber"))


@query("select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over w as bigint) as section, last_value(case when role = 'user' then turn end ignore nulls) over w as opened_at from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def win_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, SRC-14: running section ids, and the head that each line belongs to."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(so_far).alias("section"), F.last(head, ignorenulls=True).over(so_far).alias("opened_at"))


@query("with h as (select distinct extract(hour from ts) as hour from events) select cast(hour as int) as hour, cast(coalesce(lag(hour) over (order by hour), (select max(hour) from h) - 24) as int) as since from h")
def win_previous_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: the slot before, wrapping over midnight. At most 24 rows are left when they are put in order."""
    hours = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour")).distinct()
    slots = hours.agg(F.sort_array(F.collect_set("hour")).alias("h"))
    return slots.select(F.explode(F.expr("transform(h, (x, i) -> struct(x as hour, case when i = 0 then h[size(h) - 1] - 24 else h[i - 1] end as since))")).alias("x")).select("x.*")


@query(f"with {ARTICLES_SQL} select id, title from articles where country = 'en' and category = 'energy' and published_at between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 23:59:59' order by published_at desc, id limit 100")
def src_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRC-16: filters, a closed range, the newest hundred."""
    rows = articles(spark, sf_dir).filter("country = 'en' and category = 'energy' and published_at between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-20 23:59:59'")
    return rows.orderBy(F.desc("published_at"), "id").limit(100).select("id", "title")
