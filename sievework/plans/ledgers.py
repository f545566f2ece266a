"""Ledgers of a collection run: caches, logs, snapshots, reviews, images, and what is still to be delivered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefixes import explained_languages, segments
from ..sources.feeds import channel_posts, indexed, json_log, read_word_documents, written_document
from ..sources.shared import new_path
from ..sources.tables import ARTICLES_SQL, articles, table
from ..streaming.guards import single_flight, waited
from ..streaming.leases import table_stream
from ..streaming.windows import once
from .registry import query


@query(r"""with t as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\n{2,}', chr(10), 'g'), ' ' || chr(10)) as t from conversations)
select 'conv' || conv_id as channel, turn as post_id, '2024-01-01T00:00:00+00:00' as posted_at, substr(split_part(t, chr(10), 1), 1, 120) as title, substr(t, 1, 400) as summary from t where t != ''""")
def src_channel_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: messages of channel preview pages. The pages are rendered here from the conversations."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
    message = F.format_string('<div class="tgme_widget_message text_not_supported_wrap" data-post="conv%d/%d"><div class="tgme_widget_message_text js-message_text" dir="auto">%s</div><time datetime="2024-01-01T00:00:00+00:00"></time></div>', "conv_id", "turn", safe)
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list(message), ""), F.lit("</body></html>")).alias("html"))
    return channel_posts(pages)


_CACHE_SQL = "select user_id as page, arg_max(case event_type when 'error' then 404 when 'signup' then 503 else 200 end, (ts, event_id)) as status, arg_max(event_id % 3, (ts, event_id)) as parser from events group by 1"


@query(f"with cache as ({_CACHE_SQL}) select c_custkey as page, case when status is null then 'fetch' when status in (401, 403, 404, 410) then 'reuse' when status != 200 then 'fetch' when parser < 2 then 'reparse' else 'reuse' end as action from customer left join cache on page = c_custkey")
def src_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: what is fetched again: terminal answers and current parses are reused, older parses are redone from the archive."""
    status = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "signup", 503).otherwise(200)
    cache = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.max_by(F.struct(status.alias("status"), (F.col("event_id") % 3).alias("parser")), F.struct("ts", "event_id")).alias("held"))
    met = table(spark, sf_dir, "customer").select("c_custkey").join(cache, F.expr("page = c_custkey"), "left")
    action = F.expr("case when held is null then 'fetch' when held.status in (401, 403, 404, 410) then 'reuse' when held.status != 200 then 'fetch' when held.parser < 2 then 'reparse' else 'reuse' end")
    return met.select(F.col("c_custkey").alias("page"), action.alias("action"))


_CONTROL = "[\\x00-\\x08\\x0B-\\x1F]"


@query(f"with l as (select doc_id as id, unnest(string_split(regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g'), chr(10))) as text, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g'), chr(10)), 1) as line from documents) select id, cast(row_number() over (partition by id order by line) - 1 as integer) as nth, case when line = 1 then 'Heading1' else '' end as style, text from l where regexp_matches(text, '[^\\s]')")
def src_word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: paragraphs of word documents, written here from the lines of the documents."""

    @F.pandas_udf("binary")
    def document(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: written_document(t.split("\n")))

    text = F.regexp_replace(F.coalesce("text", F.lit("")), _CONTROL, "")
    return read_word_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), document(text).alias("content")))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, count(*) over (partition by json_extract(props, '$.k'), user_id, event_type) > 1 as repeated from events")
def src_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: JSON objects as rows, malformed ones end the scan; rows whose key is missing or used again are marked."""
    parsed = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))
    keyed = indexed(parsed.withColumn("key", F.concat_ws("|", "k", "user_id", "event_type")), "key")
    return keyed.select("event_id", "k", (F.coalesce("error", F.lit("")) == "repeated").alias("repeated"))


@query("select event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def src_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25: an append-only log of JSON lines, written here from the events; an invalid line aborts the scan."""
    path = new_path(spark, "event-log")
    table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")).write.json(path)
    return json_log(spark, path, "event_id long, event_type string, at string")


@query(f"with {ARTICLES_SQL} select 1 as tier, id, source from articles where country = 'en' union all select 2, id, source from articles where country != 'en' and length(content) > 2000 union all select 3, id, source from articles where category = 'energy'")
def set_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: candidate lists one after the other, rows of several lists once for each; (tier, id) is the order."""
    rows = articles(spark, sf_dir)
    lists = [rows.filter("country = 'en'"), rows.filter("country != 'en' and length(content) > 2000"), rows.filter("category = 'energy'")]
    tiers = [part.select(F.lit(k + 1).alias("tier"), "id", "source") for k, part in enumerate(lists)]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


@query("""with c as (select cast(ts as date) as issue, user_id % 40 as id, event_type || ':' || cast(user_id % 3 as varchar) as content, value from events),
k as (select issue, id, count(distinct content) as n, max(content) as content from c where value >= 10 group by all)
select strftime(issue, '%Y-%m-%d') as issue, count(*) as candidates, count(*) filter (where n > 1) as ambiguous, count(*) filter (where n = 1) between 1 and 20 as selectable, (select count(*) from c d where d.issue = k.issue and d.value < 10) as outside from k group by k.issue""")
def val_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-11: a snapshot's candidates: an id may come again with the same content only, rows outside the window are left out, and
    1 to 20 are selected."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("issue"), (F.col("user_id") % 40).alias("id"), F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string")).alias("content"), (F.col("value") >= 10).alias("inside"))
    by_id = rows.groupBy("issue", "id").agg(F.count_distinct(F.when(F.col("inside"), F.col("content"))).alias("n"), F.count_if(~F.col("inside")).alias("outside"))
    out = by_id.groupBy("issue").agg(F.count_if(F.col("n") > 0).alias("candidates"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("n") == 1).between(1, 20).alias("selectable"), F.sum("outside").alias("outside"))
    return out.filter("candidates > 0")


_REVIEW = "case when o_orderstatus != 'F' then 'verified status required' when trim(o_orderpriority) = '' or o_orderpriority like '5%' then 'reviewer required' when o_orderkey % 9 = 0 then 'hash must match' when first_seen is null then 'evidence required' when o_orderdate < first_seen - interval 60 day then 'review must follow the fetch' when o_orderdate < last_seen - interval 100 day then 'review predates evidence' end"


@query(f"with e as (select l_orderkey, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen from lineitem group by 1) select o_orderkey, {_REVIEW} as error from orders left join e on l_orderkey = o_orderkey")
def val_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-13: the first broken rule of a review's chain: status, reviewer, hash, evidence, and their order in time."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    return table(spark, sf_dir, "orders").join(seen, F.expr("l_orderkey = o_orderkey"), "left").select("o_orderkey", F.expr(_REVIEW).alias("error"))


@query("with g as (select l_orderkey, list(l_returnflag order by l_linenumber) as asked from lineitem group by 1) select l_orderkey, len(list_filter(asked, lambda x: x not in ('N', 'R'))) = 0 and len(list_distinct(asked)) = len(asked) as valid, array_to_string(list_filter(['R', 'N'], lambda x: list_contains(asked, x)), ',') as scope from g")
def evd_country_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-10: a requested scope must be a subset without repeats; it is put in the dimension's own order."""
    asked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("asked"))
    known = F.array(F.lit("R"), F.lit("N"))
    valid = (F.size(F.array_except("asked", known)) == 0) & (F.size(F.array_distinct("asked")) == F.size("asked")) & (F.size("asked") > 0)
    return asked.select("l_orderkey", valid.alias("valid"), F.array_join(F.filter(known, lambda x: F.array_contains("asked", x)), ",").alias("scope"))


_PATH_SQL = "regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1)"


@query(f"with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, {_PATH_SQL} as prefix, case when page_id % 4 = 0 then 'xx' else 'en' end as tag from pages), r as (select distinct host, prefix, length(host || prefix) % 28 as since from p where length(host || prefix) % 2 = 0) select p.page_id, p.tag, p.tag = 'en' or r.host is not null as explained from p left join r on r.host = p.host and r.prefix = p.prefix and r.since <= p.page_id % 30 + 1")
def evd_language_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-12: a wrong language tag is explained by a dated exception of its host and path prefix. Prefixes meet by equality."""
    host, prefix = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+(/[^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), prefix.alias("prefix"), F.expr("if(page_id % 4 = 0, 'xx', 'en')").alias("tag"))
    n = F.length(F.concat("host", "prefix"))
    registry = pages.filter(n % 2 == 0).select("host", "prefix", (n % 28).alias("since")).distinct()
    met = pages.join(registry, ["host", "prefix"], "left")
    return met.select("page_id", "tag", F.coalesce((F.col("tag") == "en") | (F.col("since") <= F.col("page_id") % 30 + 1), F.lit(False)).alias("explained"))


#: Rules on every second page's path: its first segments, without what lies below three of them; some are drafts or undated.
_RULE_COLUMNS = [
    "concat('r', lpad(cast(page_id as string), 9, '0')) as rule", "host", "array(array_join(slice(s, 1, cast(page_id % 2 + 1 as int)), '/')) as prefixes", "if(page_id % 6 = 0, array(array_join(slice(s, 1, 2), '/')), cast(array() as array<string>)) as excluded",
    "'xx' as declared", "lang as content", "page_id % 28 as reviewed_at", "page_id % 20 as evidence_at", "if(page_id % 10 = 0, 'draft', 'verified') as status",
]


@query(r"""with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda x: x != '') as s, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) as lang from pages),
a as (select *, case when page_id % 4 = 0 then 'xx' else lang end as declared, page_id % 30 as day from p),
r as (select page_id as rule_id, 'r' || lpad(cast(page_id as varchar), 9, '0') as rule, host, s[1:page_id % 2 + 1] as prefix, case when page_id % 6 = 0 then s[1:2] end as excluded, lang as content, page_id % 28 as reviewed_at from p where page_id % 2 = 0 and page_id % 10 != 0 and page_id % 20 <= page_id % 28),
m as (select a.page_id, min(rule) as rule from a join r on r.host = a.host and a.declared = 'xx' and r.content = a.lang and r.content != 'xx' and reviewed_at <= day and a.s[1:len(r.prefix)] = r.prefix and (excluded is null or a.s[1:len(excluded)] != excluded) group by 1)
select a.page_id as id, m.rule, case when m.rule is null then declared end as language, m.rule is null and declared = lang as verified, m.rule is null and declared = lang as matches from a left join m on m.page_id = a.page_id""")
def evd_language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-12: a wrong language tag is explained by a verified, dated rule for its host and a path prefix of any depth."""
    path = F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), path.alias("path"), segments(path).alias("s"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("lang"))
    rules = pages.filter("page_id % 2 = 0").selectExpr(*_RULE_COLUMNS)
    asked = pages.selectExpr("page_id as id", "host", "path", "if(page_id % 4 = 0, 'xx', lang) as declared", "lang as wanted", "page_id % 30 as at")
    return explained_languages(asked, rules)


@query("with f as (select user_id, event_type, min(ts) as first_at, arg_min(event_id, (ts, event_id)) as first_listing, count(*) as n from events group by all) select user_id, event_type, first_listing, row_number() over (partition by user_id order by n desc, first_at, event_type) as rank from f")
def evd_first_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-14: the first listing of each source and lead, and the leads ranked anew from the archive."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_listing"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first_at", "event_type"))  # a user has five types
    return first.select("user_id", "event_type", "first_listing", rank.alias("rank"))


IMAGES, HINTS = 24, 4
_MAIN = "(?is)<(?:article|main)[^>]*>(.*)</(?:article|main)>"
_CHROME = "(?is)<(nav|aside|footer|header|form)[^>]*>.*?</(nav|aside|footer|header|form)>"


@query(f"""with b as (select page_id, html, regexp_replace(regexp_extract(html, '{_MAIN}', 1), '{_CHROME}', ' ', 'g') as body from (select page_id, coalesce(html, '') as html from pages)),
i as (select page_id, list_distinct(regexp_extract_all(body, '<img[^>]*src="([^"]+)"', 1)) as own, list_distinct(regexp_extract_all(html, '<meta[^>]*property="og:image"[^>]*content="([^"]+)"', 1)) as hints, len(regexp_extract_all(html, '<img[^>]*>')) as in_all from b)
select page_id, least(len(own), {IMAGES}) as bound, least(len(hints), {HINTS}) as hinted, in_all from i""")
def evd_image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-18: images of the article itself, menus and the like left out, and those that the page's head hints at."""
    html = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(F.regexp_extract(html, _MAIN, 1), _CHROME, " ")
    found = lambda text, pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    own, hints = found(body, '<img[^>]*src="([^"]+)"'), found(html, '<meta[^>]*property="og:image"[^>]*content="([^"]+)"')
    return table(spark, sf_dir, "pages").select("page_id", F.least(F.size(own), F.lit(IMAGES)).alias("bound"), F.least(F.size(hints), F.lit(HINTS)).alias("hinted"), F.size(F.regexp_extract_all(html, F.lit("<img[^>]*>"), F.lit(0))).alias("in_all"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag = 'R' desc, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as attempt, case when l_linestatus = 'O' and l_quantity > 45 then 'no_image but candidates' end as error from lineitem qualify attempt <= 3")
def evd_image_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-19: lead images first, three attempts at most; a stated lack of images must agree with the candidates."""
    attempt = F.row_number().over(Window.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") == "R").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    error = F.expr("case when l_linestatus = 'O' and l_quantity > 45 then 'no_image but candidates' end")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", attempt.alias("attempt"), error.alias("error")).filter("attempt <= 3")


@query("""with r as (select cast(ts as date) as issue, user_id % 5 as country, event_id as version, event_type, hour(ts) * 60 + minute(ts) as minute from events),
l as (select issue, max(version) as version from r group by 1), d as (select distinct issue, country from r where event_type = 'purchase' and minute < 200),
m as (select issue, country, arg_max(minute, version) as minute from r group by all)
select strftime(m.issue, '%Y-%m-%d') as issue, m.country, l.version, m.minute between 350 and 569 as open, m.minute between 350 and 559 as may_start from m join l using (issue) where not exists (select 1 from d where d.issue = m.issue and d.country = m.country)""")
def evd_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-22: the latest version of an issue for the countries without a success; work is open 05:50 to 09:30, new work to 09:20."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("issue"), (F.col("user_id") % 5).alias("country"), F.col("event_id").alias("version"), "event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    latest = rows.groupBy("issue").agg(F.max("version").alias("version"))
    done = rows.filter("event_type = 'purchase' and minute < 200").select("issue", "country").distinct()
    now = rows.groupBy("issue", "country").agg(F.max_by("minute", "version").alias("minute"))
    return now.join(done, ["issue", "country"], "left_anti").join(latest, "issue").select("issue", "country", "version", F.col("minute").between(350, 569).alias("open"), F.col("minute").between(350, 559).alias("may_start"))


#: A publisher's host ends with the key; its articles stand in what the pattern finds.
TEMPLATES = {"example.net": "(?is)<article[^>]*>(.*?)</article>", "example.org": "(?is)<body[^>]*>(.*?)</body>"}
_TEMPLATE_SQL = " ".join(f"when ends_with(host, '{h}') then regexp_extract(html, '{p}', 1)" for h, p in TEMPLATES.items())


@query(f"with p as (select page_id, coalesce(html, '') as html, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages), b as (select page_id, host, case {_TEMPLATE_SQL} end as body from p) select page_id, body is not null as has_template, length(trim(regexp_replace(regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')) as n_chars from b")
def ext_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-07: article bodies by the template of the page's publisher; the templates are a parameter."""
    html, host = F.coalesce("html", F.lit("")), F.regexp_extract("url", "^https?://([^/]+)", 1)
    body = F.lit(None).cast("string")
    for ending, pattern in reversed(TEMPLATES.items()):
        body = F.when(F.endswith(host, F.lit(ending)), F.regexp_extract(html, pattern, 1)).otherwise(body)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", body.isNotNull().alias("has_template"), F.length(text).cast("long").alias("n_chars"))


@query("select event_id, user_id, event_type from events")
def stm_events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02, STM-06, STM-09, STM-10: events by id, once, as a stream that is skipped while it runs and has deadlines."""
    out, top = once(table_stream(spark, f"{sf_dir}/events.parquet"), ["event_id"]).select("event_id", "user_id", "event_type"), new_path(spark, "once")
    writer = out.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
    run = single_flight(spark, top.rsplit("/", 1)[1], writer)
    if run is None or waited(run, 600, 3600) == "stopped":
        raise RuntimeError("the events were not read to their end")
    return spark.read.schema(out.schema).parquet(f"{top}/out")
