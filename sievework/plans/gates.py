"""Projections and gates: each gate is a reason column, so that a dropped row says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any, html_to_text, keyword_score, title_key
from ..sources.tables import ARTICLES_SQL, articles, table
from .registry import query

#: Our own small vocabulary; the lists are parameters of the operators.
JUNK_WORDS = ["%%%", "###", "lorem", "$$$"]
TOPIC_WORDS = {"the": 1, "der": 1, "que": 2, "und": 3, "les": 2, "tion": 1}
OWN_WORDS = {"en": ["the ", " of "], "de": ["der ", " und "], "es": ["que ", " los "], "fr": ["les ", " une "]}
UP_WORDS, DOWN_WORDS = ["rise", "ung", "tion"], ["fall", "ver", "ent"]
TAGS = {"markets": ["the", "der"], "energy": ["que", "und"], "trade": ["les", "los"]}


def _any_sql(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _score_sql(text: str) -> str:
    return "(" + " + ".join(f"case when contains(lower({text}), '{w}') then {n} else 0 end" for w, n in TOPIC_WORDS.items()) + ")"


def country_relevant(title: Column, country: Column) -> Column:
    """Own words make a row relevant, else another country's words make it irrelevant, else it stays."""
    own = F.lit(False)
    other = F.lit(False)
    for c, words in OWN_WORDS.items():
        hit = contains_any(title, words)
        own = own | ((country == c) & hit)
        other = other | ((country != c) & hit)
    return F.when(own, True).when(other, False).otherwise(True)


_RELEVANT_SQL = "case when " + " or ".join(f"(country = '{c}' and {_any_sql('title', w)})" for c, w in OWN_WORDS.items()) + " then true when " + " or ".join(f"(country != '{c}' and {_any_sql('title', w)})" for c, w in OWN_WORDS.items()) + " then false else true end"


def drop_reason(rows: DataFrame) -> Column:
    """The first gate that a row fails, null for rows that stay."""
    return (
        F.when(contains_any(F.col("title"), JUNK_WORDS), "junk")
        .when(F.length("content") < 60, "no_body")
        .when(~country_relevant(F.col("title"), F.col("country")), "country")
        .when(keyword_score(F.col("content"), TOPIC_WORDS) == 0, "topic")
        .when(F.col("category").isin("culture", "sports"), "category")
    )


REASON_SQL = f"case when {_any_sql('title', JUNK_WORDS)} then 'junk' when length(content) < 60 then 'no_body' when not ({_RELEVANT_SQL}) then 'country' when {_score_sql('content')} = 0 then 'topic' when category in ('culture', 'sports') then 'category' end"
GATED_SQL = f"{ARTICLES_SQL}, gated as (select *, {REASON_SQL} as reason from articles)"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    return rows.withColumn("reason", drop_reason(rows))


@query(f"with {GATED_SQL} select id, country, reason from gated")
def flt_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, 02, 03, 04, 07, 08: the first failing gate of every row."""
    return gated(spark, sf_dir).select("id", "country", "reason")


@query(f"with {ARTICLES_SQL} select id, title, strftime(published_at, '%Y-%m-%d') as day from articles where published_at is null or cast(published_at as date) in (date '2024-01-10', date '2024-01-09')")
def flt_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: undated rows and those of the issue day or the day before."""
    keep = F.col("published_at").isNull() | F.to_date("published_at").isin("2024-01-10", "2024-01-09")
    return articles(spark, sf_dir).filter(keep).select("id", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


_LETTERS = "[a-zA-Z]"


@query(f"with {ARTICLES_SQL} select id, len(regexp_extract_all(title, '{_LETTERS}')) as letters, len(regexp_extract_all(title, '{_LETTERS}')) >= 4 and len(regexp_extract_all(content, '{_LETTERS}')) >= 20 as pushable from articles")
def flt_script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, STR-10: enough letters of a script in title and content; the script's class is a parameter."""
    count = lambda c: F.regexp_count(c, F.lit(_LETTERS))
    return articles(spark, sf_dir).select("id", count("title").cast("long").alias("letters"), ((count("title") >= 4) & (count("content") >= 20)).alias("pushable"))


def polarity(text: Column) -> Column:
    up, down = contains_any(text, UP_WORDS), contains_any(text, DOWN_WORDS)
    return F.when(up & ~down, "up").when(down & ~up, "down").otherwise("none")


@query(f"with {ARTICLES_SQL} select country, case when {_any_sql('title', UP_WORDS)} and not {_any_sql('title', DOWN_WORDS)} then 'up' when {_any_sql('title', DOWN_WORDS)} and not {_any_sql('title', UP_WORDS)} then 'down' else 'none' end as polarity, count(*) as n from articles group by all")
def flt_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: the direction of a title; opposite directions veto a match."""
    return articles(spark, sf_dir).groupBy("country", polarity(F.col("title")).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, regexp_matches(url, '^https://') as secure, not regexp_matches(url, '^https?://[^/]*@') as no_user, coalesce(regexp_matches(regexp_extract(url, '^https?://([^/:?#]+)', 1), '[.]example[.](com|org)$'), false) as allowed from pages")
def flt_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, URL-03: scheme, user part and allowed host of page addresses."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.col("url").rlike("^https://").alias("secure"), (~F.col("url").rlike("^https?://[^/]*@")).alias("no_user"), F.coalesce(host.rlike("[.]example[.](com|org)$"), F.lit(False)).alias("allowed"))


_STATUS = "case cast(floor(value) as bigint) % 6 when 0 then 200 when 1 then 404 when 2 then 429 when 3 then 503 when 4 then 410 end"
_RETRY = "case when status = 429 then 'rate_limited' when status is null or status >= 500 then 'transient' else 'stop' end"
_TERMINAL = "coalesce(status in (401, 403, 404, 410), false) or (event_type = 'error' and status is null)"


@query(f"with scans as (select event_id, event_type, {_STATUS} as status from events) select event_id, status, {_RETRY} as retry, {_TERMINAL} as terminal from scans")
def flt_retry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, FLT-20, EVD-26: which answers are terminal and which are tried again."""
    scans = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_STATUS).alias("status"))
    return scans.select("event_id", "status", F.expr(_RETRY).alias("retry"), F.expr(_TERMINAL).alias("terminal"))


_ELIGIBLE = "attempt is null or (attempt < 2 and (coalesce(retry_at <= {now}, false) or coalesce(lease_until < {now}, false)))"
_STATES = "select o_orderkey as id, case when o_orderstatus = 'P' then null else cast(o_orderkey % 3 as integer) end as attempt, case when o_orderstatus = 'F' then o_orderdate end as retry_at, case when o_orderstatus = 'O' then o_orderdate end as lease_until from {orders}"


@query(f"with s as ({_STATES.format(orders='orders')}) select id, {_ELIGIBLE.format(now="timestamp '1996-01-01 00:00:00'")} as eligible from s")
def flt_lease_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19, SNK-05: a step may be claimed if it never ran, or its retry is due or its lease is over."""
    states = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").selectExpr("o_orderkey as id", "case when o_orderstatus = 'P' then null else cast(o_orderkey % 3 as int) end as attempt", "case when o_orderstatus = 'F' then o_orderdate end as retry_at", "case when o_orderstatus = 'O' then o_orderdate end as lease_until")
    return states.select("id", F.expr(_ELIGIBLE.format(now="timestamp_ntz'1996-01-01 00:00:00'")).alias("eligible"))


@query("select page_id, case when regexp_matches(url, '[.](pdf|jpg|png|zip)($|[?#])') then 'static_page' when regexp_matches(url, '[?&]page=') then 'listing' when length(regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/+$', '')) = 0 then 'listing' when regexp_matches(url, '#') then 'article_deferred' else 'article_candidate' end as route from pages")
def flt_lead_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-21: what a discovered address leads to."""
    url = F.col("url")
    path = F.regexp_replace(F.regexp_extract(url, "^https?://[^/]+([^?#]*)", 1), "/+$", "")
    route = F.when(url.rlike("[.](pdf|jpg|png|zip)($|[?#])"), "static_page").when(url.rlike("[?&]page="), "listing").when(F.length(path) == 0, "listing").when(url.rlike("#"), "article_deferred").otherwise("article_candidate")
    return table(spark, sf_dir, "pages").select("page_id", route.alias("route"))


_LINKS = "regexp_extract_all(html, '<a [^>]*href=\"([^\"#]+)\"', 1)"


@query(f"with l as (select page_id, unnest({_LINKS}) as href, generate_subscripts({_LINKS}, 1) as pos from pages), f as (select page_id, href, min(pos) as pos from l where length(href) >= 5 and not regexp_matches(href, '[.](pdf|jpg|png)$') group by all) select page_id, href, cast(row_number() over (partition by page_id order by pos) as integer) as rank from f")
def flt_article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22, SET-02, EVD-13: the links of a page that may be articles, once each, in page order."""
    from pyspark.sql import Window

    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"#]+)"'), F.lit(1))).alias("pos", "href"))
    first = links.filter((F.length("href") >= 5) & ~F.col("href").rlike("[.](pdf|jpg|png)$")).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return first.select("page_id", "href", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("rank"))


@query(f"with {ARTICLES_SQL} select id, coalesce(nullif(title, ''), 'untitled') as title, true as \"isFeatured\", source as \"sourceName\", substr(regexp_replace(content, '<[^>]*>', ' ', 'g'), 1, 200) as peek, strftime(published_at, '%Y-%m-%dT%H:%M') as time, contains(content, '<img') as \"hasImage\" from articles")
def prj_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, 02, 03: the rows an editor sees, with defaults; a missing column is an error, a null is not."""
    return articles(spark, sf_dir).select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), F.lit(True).alias("isFeatured"), F.col("source").alias("sourceName"), F.substring(F.regexp_replace("content", "<[^>]*>", " "), 1, 200).alias("peek"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm").alias("time"), F.contains("content", F.lit("<img")).alias("hasImage"))


@query(f"with {ARTICLES_SQL} select id, sha256(concat_ws('|', title, coalesce(country, ''), coalesce(source, ''), category)) as fingerprint, sha256(content) as body_hash, octet_length(encode(content)) as body_bytes from articles")
def prj_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04, JS-01, JS-05, SNK-08, EVD-04: a hash of what editors care about, apart from volatile columns."""
    key = F.concat_ws("|", "title", F.coalesce("country", F.lit("")), F.coalesce("source", F.lit("")), "category")
    return articles(spark, sf_dir).select("id", F.sha2(key, 256).alias("fingerprint"), F.sha2("content", 256).alias("body_hash"), F.octet_length("content").cast("long").alias("body_bytes"))


_TAGS_SQL = "list_filter([" + ", ".join(f"case when {_any_sql('title', w)} then '{t}' end" for t, w in TAGS.items()) + "], lambda x: x is not null)"


@query(f"with {ARTICLES_SQL} select id, array_to_string(case when len({_TAGS_SQL}) = 0 then ['general'] else {_TAGS_SQL} end, ',') as tags, list_contains({_TAGS_SQL}, 'energy') as tagged from articles")
def prj_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, FLT-10: keyword buckets, with a default, and the filter on one of them."""
    tags = F.array_compact(F.array(*(F.when(contains_any(F.col("title"), w), t) for t, w in TAGS.items())))
    return articles(spark, sf_dir).select("id", F.array_join(F.when(F.size(tags) == 0, F.array(F.lit("general"))).otherwise(tags), ",").alias("tags"), F.array_contains(tags, "energy").alias("tagged"))


_HITS = {c: " + ".join(f"cast(contains(lower(title), '{w}') as int)" for w in words) for c, words in OWN_WORDS.items()}
_BEST = "case " + " ".join("when " + " and ".join(f"({_HITS[c]}) {'>' if list(_HITS).index(o) < list(_HITS).index(c) else '>='} ({_HITS[o]})" for o in _HITS if o != c) + f" and ({_HITS[c]}) > 0 then '{c}'" for c in _HITS) + " end"


@query(f"with {ARTICLES_SQL} select id, case when id % 4 = 0 then {_BEST} else country end as country from articles")
def prj_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07: rows of international sources go to the country with most keywords; the first of equals wins."""
    hits = F.array(*(F.struct(sum(F.contains(F.lower("title"), F.lit(w)).cast("int") for w in words).alias("hits"), F.lit(-k).alias("order"), F.lit(c).alias("country")) for k, (c, words) in enumerate(OWN_WORDS.items())))
    best = F.array_max(hits)
    return articles(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, F.when(best["hits"] > 0, best["country"])).otherwise(F.col("country")).alias("country"))


_CATEGORY = [("energy", ["öl", "gas", "que"]), ("finance", ["bank", "und"]), ("culture", ["the"])]


@query(f"with {ARTICLES_SQL} select id, case " + " ".join(f"when {_any_sql('title', w)} then '{c}'" for c, w in _CATEGORY) + " else 'economy' end as category from articles")
def prj_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: the first matching rule, else a default."""
    rule = F.when(contains_any(F.col("title"), _CATEGORY[0][1]), _CATEGORY[0][0])
    for name, words in _CATEGORY[1:]:
        rule = rule.when(contains_any(F.col("title"), words), name)
    return articles(spark, sf_dir).select("id", rule.otherwise("economy").alias("category"))


@query("select page_id, case when html is null or trim(html) = '' then 'empty' when regexp_matches(html, '(?i)^\\s*<!doctype html|^\\s*<html') then 'html' else null end as reason, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def src_not_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: why an answer is no feed."""
    html = F.col("html")
    reason = F.when(html.isNull() | (F.trim(html) == ""), "empty").when(html.rlike(r"(?i)^\s*<!doctype html|^\s*<html"), "html")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def ext_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-03, EXT-04, SRC-08: a page's text and its length, its images and its preview image."""
    images = F.filter(F.regexp_extract_all("html", F.lit('<img [^>]*src="([^"]+)"'), F.lit(1)), lambda s: ~s.rlike("^data:|pixel"))
    text = html_to_text(F.col("html"))
    preview = F.coalesce(F.nullif(F.regexp_extract("html", 'property="og:image" content="(http[^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("html", 'content="(http[^"]+)" property="og:image"', 1), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), (F.length(text) < 60).alias("needs_body"), F.size(images).alias("n_images"), preview.alias("preview"))


def identity_keys(rows: DataFrame) -> DataFrame:
    """DD-01: rows with their address key and their title key within a country."""
    from ..functions.text import canonical_url

    return rows.withColumn("url_key", canonical_url(F.col("url"))).withColumn("title_key", title_key(F.col("title")))
