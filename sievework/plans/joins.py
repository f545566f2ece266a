"""Join-shaped queries: anti joins, similarity joins, as-of and prefix joins, diffs, greedy and set-based deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefixes import longest_prefix, segments
from ..operators.similarity import components, first_seen, similar_between, similar_pairs
from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import identity_keys
from .registry import query
from .scalars import GRAMS_SQL, NORM_SQL, TITLE_KEY_SQL, canonical_sql

FLOOR = 0.9
KEYED_SQL = f"{ARTICLES_SQL}, keyed as (select *, {canonical_sql('url')} as url_key, {TITLE_KEY_SQL} as title_key from articles)"
PAIRS_SQL = f"""{ARTICLES_SQL}, normal as (select id, country, {NORM_SQL.format(x='title')} as norm from articles),
classes as (select country, norm, min(id) as id, list(id) as ids from normal where norm != '' and country is not null group by all),
grams as (select id, country, case when length(replace(norm, ' ', '')) <= 1 then [replace(norm, ' ', '')] else {GRAMS_SQL.format(x='norm')} end as g from classes),
near as (select a.id as a, b.id as b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) as sim from grams a join grams b on a.country = b.country and a.id < b.id),
pairs as (select a, b, sim from near where sim >= {FLOOR} union all select id, unnest(list_filter(ids, lambda i: i > id)), 1.0 from classes)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("id", F.col("country").alias("block"), "title").filter("block is not null")
    return similar_pairs(rows, FLOOR)


@query(f"with {KEYED_SQL}, old as (select * from keyed where published_at < timestamp '2024-01-25 00:00:00'), new as (select * from keyed where published_at >= timestamp '2024-01-25 00:00:00') select id, url_key from new where not exists (select 1 from old where old.url_key = new.url_key) and (title_key = '' or not exists (select 1 from old where old.title_key = new.title_key))")
def jn_not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-02, STM-02: new rows whose address and title are not stored; two anti joins, not one with OR."""
    rows = identity_keys(articles(spark, sf_dir))
    old, new = rows.filter("published_at < timestamp_ntz'2024-01-25 00:00:00'"), rows.filter("published_at >= timestamp_ntz'2024-01-25 00:00:00'")
    left = new.join(old.select("url_key"), "url_key", "left_anti")
    untitled = left.filter("title_key = ''").select("id", "url_key")  # a key that many share, and that matches nothing
    titled = left.filter("title_key != ''").join(old.filter("title_key != ''").select("title_key"), "title_key", "left_anti")
    return untitled.union(titled.select("id", "url_key"))


@query(f"with {PAIRS_SQL} select a, b, round(sim, 9) as sim from pairs")
def jn_similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, JN-04, DD-04, FLT-14: titles of a country with enough bigrams in common."""
    return _pairs(spark, sf_dir).select("a", "b", F.round("sim", 9).alias("sim"))


#: The floor of the reference data's own recall.
LOW_FLOOR = 0.28


@query(f"with {PAIRS_SQL.replace(f'sim >= {FLOOR}', f'sim >= {LOW_FLOOR}')} select a, b, round(sim, 9) as sim from pairs")
def jn_recalled_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, JN-03, JN-04: titles of a country at the floor of a first recall, where most pairs reach it: they
    are counted in tiles and not kept."""
    rows = articles(spark, sf_dir).select("id", F.col("country").alias("block"), "title").filter("block is not null")
    return similar_pairs(rows, LOW_FLOOR, staged=False).select("a", "b", F.round("sim", 9).alias("sim"))


@query(f"with recursive {PAIRS_SQL}, ways as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as root from ways union select ways.b, root from reach join ways on ways.a = reach.id and root < ways.b), c as (select id, min(root) as root from reach group by id) select root, count(*) as size, count(*) <= 4 as merged from c group by root")
def dd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-05, DD-07, DD-08, FLT-13, EV-02: components of similar titles; oversize ones are not merged."""
    groups = components(_pairs(spark, sf_dir)).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return groups.select("root", "size", (F.col("size") <= 4).alias("merged"))


@query()
def dd_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, DD-02: in the order of id a row goes iff an earlier kept row has its address or its title."""
    return first_seen(identity_keys(articles(spark, sf_dir)), ["url_key", "title_key"])


PUBLISHED_FLOOR = 0.4
_PUBLISHED_SQL = f"""{ARTICLES_SQL}, c as (select id, {NORM_SQL.format(x='title')} as t from articles), b as (select item_id, {NORM_SQL.format(x='text')} as t from benchmark),
g as (select id, case when length(replace(t, ' ', '')) <= 1 then [replace(t, ' ', '')] else {GRAMS_SQL.format(x='t')} end as g from c where t != ''), h as (select item_id, case when length(replace(t, ' ', '')) <= 1 then [replace(t, ' ', '')] else {GRAMS_SQL.format(x='t')} end as h from b where t != ''),
p as (select id, item_id, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) as sim from g, h)"""


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = articles(spark, sf_dir).select("id", F.lit("all").alias("block"), "title")
    theirs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("block"), F.col("text").alias("title"))
    return similar_between(ours, theirs, PUBLISHED_FLOOR)


@query(f"with {_PUBLISHED_SQL} select id as a, item_id as b, round(sim, 9) as sim from p where sim >= {PUBLISHED_FLOOR}")
def jn_published_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06: all pairs of rows and published items over the floor; the rarest grams of either side meet."""
    return _published(spark, sf_dir).select("a", "b", F.round("sim", 9).alias("sim"))


@query(f"with {_PUBLISHED_SQL} select id, item_id, round(sim, 9) as sim from p where sim >= {PUBLISHED_FLOOR} qualify row_number() over (partition by id order by sim desc, item_id) = 1")
def jn_best_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07, EV-12, FLT-17: for each row the best item published before, if it reaches the floor."""
    best = _published(spark, sf_dir).groupBy("a").agg(F.max(F.struct("sim", (-F.col("b")).alias("k"))).alias("p"))
    return best.select(F.col("a").alias("id"), (-F.col("p.k")).alias("item_id"), F.round("p.sim", 9).alias("sim"))


@query("with p as (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as host, '/' || split_part(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/', 2) as prefix, 'family' || length(url) % 7 as family from pages union select distinct regexp_extract(url, '^https?://([^/]+)', 1), '', 'family0' from pages), q as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) as path from pages), m as (select page_id, prefix, family, rank() over (partition by page_id order by length(prefix) desc) as r from p join q using (host) where starts_with(path, prefix)) select page_id, case when count(distinct family) = 1 then min(family) end as family from m where r = 1 group by page_id")
def jn_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08: the publisher with the longest path prefix on a host; null if several share it."""
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages")
    known = pages.select(host.alias("host"), F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))).alias("prefix"), F.concat(F.lit("family"), F.length("url") % 7).alias("family")).union(pages.select(host, F.lit(""), F.lit("family0"))).distinct()
    # a path has few prefixes: they are listed and met by equality, so no host is compared with all its prefixes
    asked = pages.select("page_id", host.alias("host"), F.explode(F.array(F.lit(""), F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))))).alias("prefix"), path.alias("path")).filter(F.startswith("path", "prefix")).distinct()
    met = asked.join(known, ["host", "prefix"]).groupBy("page_id", F.length("prefix").alias("n")).agg(F.countDistinct("family").alias("families"), F.min("family").alias("family"))
    best = met.groupBy("page_id").agg(F.max(F.struct("n", "families", "family")).alias("b"))
    return best.select("page_id", F.when(F.col("b.families") == 1, F.col("b.family")).alias("family"))


#: The addresses' own segments, and three more by the page, so that paths and registered prefixes are up to five deep.
_DEEP = "regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/+$', '') || '/s' || page_id % 3 || '/t' || page_id % 2 || '/u'"
_DEEP_SQL = f"p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, string_split(substr({_DEEP}, 2), '/') as s from pages)"


@query(f"with {_DEEP_SQL}, k as (select distinct host, array_to_string(s[1:page_id % 6], '/') as prefix, 'family' || length(host) % 5 + page_id % 2 as name from p), m as (select page_id, prefix, count(distinct name) as n, min(name) as name from p join k on k.host = p.host and k.prefix in (select array_to_string(s[1:i], '/') from unnest(range(0, 6)) as r(i)) group by all) select p.page_id as id, b.prefix, b.name from p left join (select page_id, case when prefix = '' then '' else '/' || prefix end as prefix, case when n = 1 then name end as name from m qualify row_number() over (partition by page_id order by length(prefix) desc) = 1) b on b.page_id = p.page_id")
def jn_deep_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08: the publisher with the longest registered prefix of a page's path, of any depth; null if several share it."""
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.expr(_DEEP)
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    known = pages.select("host", F.array_join(F.slice(segments(F.col("path")), 1, (F.col("page_id") % 6).cast("int")), "/").alias("prefix"), F.concat(F.lit("family"), (F.length("host") % 5 + F.col("page_id") % 2).cast("string")).alias("name"))
    return longest_prefix(pages.select(F.col("page_id").alias("id"), "host", "path"), known.distinct())


@query("select e.event_id, (select max(p.event_id) from (select event_id, user_id, ts from events where event_type = 'click') p where p.user_id = e.user_id and p.ts = (select max(ts) from events q where q.event_type = 'click' and q.user_id = e.user_id and q.ts <= e.ts)) as evidence_id from events e where e.event_type = 'purchase'")
def jn_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09, JN-10: the latest earlier observation for each record; one window over both sides, no inequality join."""
    events = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')")
    past = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    evidence = F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(past)
    return events.select("event_id", "event_type", evidence["event_id"].alias("evidence_id")).filter("event_type = 'purchase'").select("event_id", "evidence_id")


_DIFF = "case when revision_a is null then 'added' when revision_b is null then 'removed' when revision_a != revision_b then 'changed' else 'retained' end"


@query(f"with {ARTICLES_SQL}, a as (select id, id % 7 as revision_a from articles where id % 5 != 0), b as (select id, case when id % 11 = 0 then 99 else id % 7 end as revision_b from articles where id % 6 != 0) select id, {_DIFF} as change from a full join b using (id)")
def jn_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, EVD-02, STM-04, SET-05: what changed between two snapshots."""
    rows = articles(spark, sf_dir)
    a = rows.filter("id % 5 != 0").selectExpr("id", "id % 7 as revision_a")
    b = rows.filter("id % 6 != 0").selectExpr("id", "case when id % 11 = 0 then 99 else id % 7 end as revision_b")
    return a.join(b, "id", "full_outer").select("id", F.expr(_DIFF).alias("change"))


@query("select n.n_name, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey group by all")
def jn_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, EVD-23: state rows turned to a column for each step."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.groupBy("n_name").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"))


@query("select c_custkey, 'not_scanned' as state from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select c_custkey, 'open' from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def jn_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16, JN-17, SRC-22, SNK-03: keys without a row, and keys with one, by anti and semi joins."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    none = customers.join(orders, F.expr("o_custkey = c_custkey"), "left_anti").withColumn("state", F.lit("not_scanned"))
    return none.union(customers.join(orders.filter("o_orderstatus = 'O'"), F.expr("o_custkey = c_custkey"), "left_semi").withColumn("state", F.lit("open")))


@query("with pick as (select l_orderkey, list_distinct(list(l_suppkey)) as s, list_distinct(list(l_partkey % 100)) as p from lineitem group by all) select l_orderkey, len(list_filter(s, lambda x: not list_contains(p, x))) = 0 as is_subset, len(list_intersect(s, p)) > 0 as overlaps from pick")
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-04, EV-09, VAL-14: subset, equality and overlap of gathered sets."""
    picked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set(F.col("l_partkey") % 100).alias("p"))
    return picked.select("l_orderkey", (F.size(F.array_except("s", "p")) == 0).alias("is_subset"), F.arrays_overlap("s", "p").alias("overlaps"))


@query(f"with {PAIRS_SQL}, g as (select a.doc_id as x, b.doc_id as y, a.quality = b.quality as truth from labels a join labels b on a.doc_id < b.doc_id join pairs on pairs.a = a.doc_id and pairs.b = b.doc_id) select count(*) filter (where truth) as tp, count(*) filter (where not truth) as fp, count(*) as n from g")
def ev_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-01, EV-06, EV-08: pairs at the floor held against labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = _pairs(spark, sf_dir).join(labels.toDF("a", "q_a"), "a").join(labels.toDF("b", "q_b"), "b")
    return judged.agg(F.count_if(F.expr("q_a = q_b")).alias("tp"), F.count_if(F.expr("q_a != q_b")).alias("fp"), F.count(F.lit(1)).alias("n"))


@query(f"with {PAIRS_SQL} select case when sim >= 1 then 'equal' when sim >= 0.95 then '0.95' else '0.90' end as bucket, count(*) as n from pairs group by all")
def ev_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-03, EV-04, TOP-09: pairs by band of similarity."""
    bucket = F.when(F.col("sim") >= 1, "equal").when(F.col("sim") >= 0.95, "0.95").otherwise("0.90")
    return _pairs(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
