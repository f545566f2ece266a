"""Text strippers, fingerprints, times and validators: rule columns and first failing rules, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, html_to_text, is_subsequence, outside_protected
from ..operators.substrings import common_substrings, quoted_spans
from ..sources.tables import ARTICLES_SQL, articles, table
from .registry import query

_NUMBERS = "[0-9]+"


@query(f"with {ARTICLES_SQL}, n as (select id, regexp_extract_all(title, '{_NUMBERS}') as a, regexp_extract_all(content, '{_NUMBERS}') as b from articles), p as (select id, len(a) as na, len(b) as nb, '|' || array_to_string(a, '||') || '|' as ta, '|' || array_to_string(b, '||') || '|' as tb, '%|' || array_to_string(a, '|%|') || '|%' as pa, '%|' || array_to_string(b, '|%|') || '|%' as pb from n) select id, na > 0 and nb > 0 and not (tb like pa) and not (ta like pb) as conflict from p")
def flt_number_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: number lists conflict unless one is empty or an ordered subsequence of the other; a fold, not a UDF."""
    found = lambda c: F.regexp_extract_all(c, F.lit(_NUMBERS), F.lit(0))
    rows = articles(spark, sf_dir).select("id", found(F.col("title")).alias("a"), found(F.col("content")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("id", ((F.size(a) > 0) & (F.size(b) > 0) & ~is_subsequence(a, b) & ~is_subsequence(b, a)).alias("conflict"))


@query(f"with {ARTICLES_SQL} select id, regexp_matches(title, '(?i)[(]source: *[)]|[(] *[)] *$') as missing_source, len(regexp_extract_all(content, '(?i)[0-9]+ times (less|lower|fewer)')) as n_descending from articles")
def flt_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, STR-12: titles with an empty source; phrases that shrink by multiples."""
    return articles(spark, sf_dir).select("id", F.col("title").rlike("(?i)[(]source: *[)]|[(] *[)] *$").alias("missing_source"), F.regexp_count("content", F.lit("(?i)[0-9]+ times (less|lower|fewer)")).cast("long").alias("n_descending"))


_MIXED = ("[a-zA-Z]", "[à-ÿ]")


@query(f"with {ARTICLES_SQL} select id, len(list_filter(string_split(title, ' '), lambda t: regexp_matches(t, '{_MIXED[0]}') and regexp_matches(t, '{_MIXED[1]}') and not regexp_matches(t, '^[A-Z]'))) as mixed from articles")
def str_mixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: tokens with characters of two classes, names left out; the classes are parameters."""
    mixed = F.filter(F.split("title", " "), lambda t: t.rlike(_MIXED[0]) & t.rlike(_MIXED[1]) & ~t.rlike("^[A-Z]"))
    return articles(spark, sf_dir).select("id", F.size(mixed).cast("long").alias("mixed"))


_PIECES = "<[^>]*>|«[^»]*»|[^<«]+|[<«]"


@query(f"select page_id, array_to_string(list_transform(regexp_extract_all(html, '{_PIECES}'), lambda p: case when regexp_matches(p, '^(<.*>|«.*»)$', 's') then p else regexp_replace(p, '[(][^()]*[)]|[à-ÿ]+', '', 'g') end), '') as stripped from pages")
def str_outside_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13, STR-15: runs of a script and bracketed notes stripped, but not inside tags and quoted titles."""
    return table(spark, sf_dir, "pages").select("page_id", outside_protected(F.col("html"), "[(][^()]*[)]|[à-ÿ]+").alias("stripped"))


@query()
def str_doubled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: a run of two to ten letters that stands twice at the start of a word is written once (needs a back reference)."""
    return articles(spark, sf_dir).select("id", F.regexp_replace("title", r"\b(\p{L}{2,10})\1", "$1").alias("title"))


_TIGHT = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"with {ARTICLES_SQL}, t as (select id, {_TIGHT.format(x='title')} as a, {_TIGHT.format(x='content')} as b from articles) select id, a = b or (least(length(a), length(b)) >= 8 and (contains(a, b) or contains(b, a))) as same_title, (length(a) >= 8 and left(a, 8) = left(b, 8)) or (length(a) >= 6 and right(a, 6) = right(b, 6)) as shares_enough from t")
def str_same_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17: titles that are equal, contain each other, or share an end."""
    tight = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    rows = articles(spark, sf_dir).select("id", tight(F.col("title")).alias("a"), tight(F.col("content")).alias("b"))
    return rows.selectExpr("id", "a = b or (least(length(a), length(b)) >= 8 and (contains(a, b) or contains(b, a))) as same_title", "(length(a) >= 8 and left(a, 8) = left(b, 8)) or (length(a) >= 6 and right(a, 6) = right(b, 6)) as shares_enough")


_COMMON_SQL = "list_reduce(list_prepend(0, range(1, length({a}) + 1)), lambda n, i: case when contains({b}, substr({a}, i - n, n + 1)) then n + 1 else n end)"


@query(f"with {ARTICLES_SQL}, t as (select id, title as a, substr(content, length(title) + 1) as b from articles where length(title) > 0) select id, {_COMMON_SQL.format(a='a', b='b')} as n_common from t")
def str_common_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: length of the longest substring that a title shares with the text below it, by a suffix automaton."""
    rows = articles(spark, sf_dir).filter(F.length("title") > 0).select("id", "title", F.expr("substr(content, length(title) + 1)").alias("rest"))
    return common_substrings(rows, "id", "title", "rest").select("id", "n_common")


#: The fewest letters and digits that count as a quotation.
QUOTE_LEAST = 16


@query(f"""with {ARTICLES_SQL}, r as (select item_id as reason_id, regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g') as a from benchmark), s as (select id as source_id, regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g') as b from articles),
g as (select distinct reason_id, substr(a, unnest(range(1, length(a) - {QUOTE_LEAST - 2})), {QUOTE_LEAST}) as x from r), h as (select distinct source_id, substr(b, unnest(range(1, length(b) - {QUOTE_LEAST - 2})), {QUOTE_LEAST}) as x from s),
m as (select distinct reason_id, source_id from g join h using (x)) select reason_id, source_id, {_COMMON_SQL.format(a='b', b='a')} as n_common from m join r using (reason_id) join s using (source_id)""")
def str_quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: what of a published item is quoted from which titles: the longest span of letters and digits."""
    reasons = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reason_id"), "text")
    sources = articles(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("title").alias("text"))
    return quoted_spans(reasons, sources, QUOTE_LEAST).select("reason_id", "source_id", "n_common")


_FNV_SQL = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({x}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"with {ARTICLES_SQL} select id, case when title = '' then 2166136261 else {_FNV_SQL.format(x='title')} end as hash, length(title) as n from articles")
def js_text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS-02: FNV-1a over UTF-16 units, with the length; a fold in the JVM."""
    return articles(spark, sf_dir).select("id", fingerprint(F.col("title")).alias("hash"), F.length("title").cast("long").alias("n"))


@query(f"with p as (select distinct l_orderkey, least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem), j as (select l_orderkey, string_agg(a || '-' || b, ',' order by a, b) as j from p group by 1) select l_orderkey, {_FNV_SQL.format(x='j')} as hash from j")
def js_pair_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS-03: a fingerprint of a set of pairs, whatever their order and direction."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")))).alias("p"))
    return pairs.select("l_orderkey", fingerprint(F.array_join(F.transform("p", lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))), ",")).alias("hash"))


_RAW = "case event_id % 5 when 0 then {full} || 'Z' when 1 then {full} when 2 then {day} when 3 then {full} || '+08:00' else 'soon' end"
_PRECISION = "case when {m}(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then 'day' when {m}(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then 'second' when {m}(raw, '^[0-9]{{4}}-') then 'naive' end"


@query("with r as (select event_id, " + _RAW.format(full="strftime(ts, '%Y-%m-%dT%H:%M:%S')", day="strftime(ts, '%Y-%m-%d')") + f" as raw from events), p as (select *, {_PRECISION.format(m='regexp_matches')} as precision from r) select event_id, precision, strftime(coalesce(case when precision = 'second' then try_cast(substr(raw, 1, 19) as timestamp) - case when raw like '%+08:00' then interval 8 hour else interval 0 hour end end, timestamp '2024-02-01 00:00:00'), '%Y-%m-%d %H:%M:%S') as safe from p")
def dt_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-04, DT-05, EVD-20: how exact a time is; one without a zone is no time, and falls back to a given now."""
    raw = F.expr(_RAW.format(full="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", day="date_format(ts, 'yyyy-MM-dd')"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("precision", F.expr(_PRECISION.format(m="regexp_like")))
    local = F.expr("try_cast(substr(raw, 1, 19) as timestamp_ntz)")
    utc = F.when(F.col("raw").endswith("+08:00"), local - F.expr("interval 8 hours")).otherwise(local)
    return rows.select("event_id", "precision", F.date_format(F.coalesce(F.when(F.col("precision") == "second", utc), F.expr("timestamp_ntz'2024-02-01 00:00:00'")), "yyyy-MM-dd HH:mm:ss").alias("safe"))


@query("select user_id, case when count(*) filter (where event_type in ('click', 'purchase')) = 0 then 'none' when bool_and(ts >= timestamp '2024-01-14 22:00:00' and ts < timestamp '2024-01-15 22:00:00') filter (where event_type in ('click', 'purchase')) then 'in' when bool_or(ts >= timestamp '2024-01-14 22:00:00' and ts < timestamp '2024-01-15 22:00:00') filter (where event_type in ('click', 'purchase')) then 'uncertain' else 'out' end as vote from events group by user_id")
def dt_window_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-06, DT-08, DT-09: explicit evidence votes in or out of a window; disagreement is uncertain."""
    inside = F.expr("ts >= timestamp_ntz'2024-01-14 22:00:00' and ts < timestamp_ntz'2024-01-15 22:00:00'")
    counts = table(spark, sf_dir, "events").filter("ts is not null").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("n"), F.count_if(F.col("event_type").isin("click", "purchase") & inside).alias("k"))
    return counts.select("user_id", F.expr("case when n = 0 then 'none' when k = n then 'in' when k > 0 then 'uncertain' else 'out' end").alias("vote"))


_SCALED = "case when v >= 100 then rtrim(rtrim(cast(cast(v / 100 as decimal(18, 4)) as {s}), '0'), '.') || '亿' else rtrim(rtrim(cast(cast(v * 100 as decimal(18, 2)) as {s}), '0'), '.') || '万' end"


@query(f"with p as (select p_partkey, cast(p_size as decimal(18, 2)) * 7 as v from part) select p_partkey, {_SCALED.format(s='varchar')} as written from p")
def num_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-04: so many millions, written in units of ten thousand or a hundred million without closing zeros."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size as decimal(18, 2)) * 7 as v")
    written = "case when v >= 100 then trim(TRAILING '.' FROM trim(TRAILING '0' FROM cast(cast(v / 100 as decimal(18, 4)) as string))) || '亿' else trim(TRAILING '.' FROM trim(TRAILING '0' FROM cast(cast(v * 100 as decimal(18, 2)) as string))) || '万' end"
    return rows.selectExpr("p_partkey", f"{written} as written")


_UNIT_ERROR = "case when a <= 0 or b <= 0 then null when b / a >= 5 or b / a <= 0.2 then 'scale' when u = 'MW' and w = 'MWh' then 'power_as_energy' when u = 'MWh' and w = 'MW' then 'energy_as_power' end"


@query(f"with s as (select l_orderkey, l_linenumber, l_quantity as a, l_quantity * (1 + l_linenumber) as b, case when l_returnflag = 'R' then 'MW' else 'MWh' end as u, case when l_linestatus = 'F' then 'MW' else 'MWh' end as w from lineitem) select l_orderkey, l_linenumber, {_UNIT_ERROR} as error from s")
def num_unit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-05: amounts of a pair whose scale or kind of unit can't both be right."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity as a", "l_quantity * (1 + l_linenumber) as b", "if(l_returnflag = 'R', 'MW', 'MWh') as u", "if(l_linestatus = 'F', 'MW', 'MWh') as w")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{_UNIT_ERROR} as error")


_PLAIN_SQL = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))"
_ARTICLE = "(?is)<article[^>]*>(.*?)</article>"
_PARAGRAPH = "(?is)<p[^>]*>(.*?)</p>"
BODY_FLOOR, BODY_CHARS = 60, 6000


@query(f"with t as (select page_id, {_PLAIN_SQL.format(x=f"regexp_extract(html, '{_ARTICLE}', 1)")} as a, {_PLAIN_SQL.format(x=f"array_to_string(regexp_extract_all(html, '{_PARAGRAPH}', 1), ' ')")} as p from (select page_id, coalesce(html, '') as html from pages)) select page_id, case when length(a) >= {BODY_FLOOR} then 'container' when length(p) >= {BODY_FLOOR} then 'paragraphs' end as via, substr(case when length(a) >= {BODY_FLOOR} then a when length(p) >= {BODY_FLOOR} then p end, 1, {BODY_CHARS}) as body from t")
def ext_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, 07 and parts of EXT-01, EXT-02, SRC-11: a page's body by its container or else its paragraphs, and by which.

    Not built: JSON-LD articleBody, the longest of several containers, removal of chrome, and SRC-11's title, links, times,
    canonical and images.
    """
    html = F.coalesce("html", F.lit(""))
    rows = table(spark, sf_dir, "pages").select("page_id", html_to_text(F.regexp_extract(html, _ARTICLE, 1)).alias("a"), html_to_text(F.array_join(F.regexp_extract_all(html, F.lit(_PARAGRAPH), F.lit(1)), " ")).alias("p"))
    via = F.when(F.length("a") >= BODY_FLOOR, "container").when(F.length("p") >= BODY_FLOOR, "paragraphs")
    body = F.when(F.length("a") >= BODY_FLOOR, F.col("a")).when(F.length("p") >= BODY_FLOOR, F.col("p"))
    return rows.select("page_id", via.alias("via"), F.substring(body, 1, BODY_CHARS).alias("body"))


_HOSTS = {"http://": "https://", "/static/": "https://cdn.example.org/", "#top": ""}


@query("select page_id, " + "".join("replace(" for _ in _HOSTS) + "url" + "".join(f", '{a}', '{b}')" for a, b in _HOSTS.items()) + " as url from pages")
def ext_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-05: addresses rewritten by a map, its entries in order."""
    entries = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _HOSTS.items()))
    return table(spark, sf_dir, "pages").select("page_id", F.aggregate(entries, F.col("url"), lambda s, e: F.replace(s, e["a"], e["b"])).alias("url"))


_EVIDENCE = [("meta", 'article:published_time"'), ("jsonld", '"datePublished"'), ("time", "<time[^>]*datetime="), ("heading", "<h1[^>]*>")]


@query("select page_id, list_filter([" + ", ".join(f"case when regexp_matches(html, '{p}') then '{k}' end" for k, p in _EVIDENCE) + "], lambda x: x is not null)[1] as best, len(list_filter([" + ", ".join(f"case when regexp_matches(html, '{p}') then '{k}' end" for k, p in _EVIDENCE) + "], lambda x: x is not null)) as n, case when contains(html, '<article') and len(regexp_extract_all(html, '<p[ >]')) >= 3 then 'article' when len(regexp_extract_all(html, '<a ')) >= 10 then 'listing' else 'unknown' end as kind from pages where html is not null")
def ext_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-06, EVD-16, EVD-17: the evidence for a page's publication in the order of its weight, and the page's kind."""
    found = F.array_compact(F.array(*(F.when(F.col("html").rlike(p), F.lit(k)) for k, p in _EVIDENCE)))
    count = lambda p: F.regexp_count("html", F.lit(p))
    kind = F.when(F.contains("html", F.lit("<article")) & (count("<p[ >]") >= 3), "article").when(count("<a ") >= 10, "listing").otherwise("unknown")
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.get(found, 0).alias("best"), F.size(found).cast("long").alias("n"), kind.alias("kind"))


_CURRENCY = {"en": "pound", "de": "euro", "es": "que", "fr": "franc"}


def _currency(contains: str) -> str:
    own = "case country " + " ".join(f"when '{c}' then {contains}(body, '{w}')" for c, w in _CURRENCY.items()) + " else false end"
    foreign = " or ".join(f"(country != '{c}' and {contains}(body, '{w}'))" for c, w in _CURRENCY.items())
    return f"country is not null and not ({own}) and ({foreign})"


@query(f"with {ARTICLES_SQL}, b as (select id, country, lower(content) as body from articles) select id, {_currency('contains')} as misfit, regexp_matches(body, '(^|[^a-z])on the [0-9]{{1,2}}(st|nd|rd|th)') and not regexp_matches(body, 'january|february|march|april|june|july|august') as day_without_month from b")
def val_country_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-02, VAL-05: a foreign currency where the own one is missing; days without a month."""
    rows = articles(spark, sf_dir).select("id", "country", F.lower("content").alias("body"))
    return rows.select("id", F.expr(_currency("contains")).alias("misfit"), (F.col("body").rlike("(^|[^a-z])on the [0-9]{1,2}(st|nd|rd|th)") & ~F.col("body").rlike("january|february|march|april|june|july|august")).alias("day_without_month"))


#: wrong name, right name, country (null: all)
_NAMES = [("thth", "the", "en"), ("derder", "der", None), ("queque", "que", "es"), ("tiontion", "tion", None)]


@query(f"with {ARTICLES_SQL}, d(wrong, good, scope) as (values " + ", ".join(f"('{a}', '{b}', {'null' if c is None else repr(c)})" for a, b, c in _NAMES) + ") select id, wrong, good from articles join d on contains(lower(content), wrong) and (scope is null or scope = country)")
def val_wrong_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-03, VAL-04, EVD-28: a fixed dictionary of wrong names, some for one country only."""
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("content"), F.lit(a)) & (F.lit(True) if c is None else F.col("country") == c), F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("good"))) for a, b, c in _NAMES)))
    return articles(spark, sf_dir).select("id", F.explode(hits).alias("h")).select("id", "h.wrong", "h.good")


@query("with g as (select l_suppkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as dup, count(*) filter (where l_returnflag = 'A' and l_linenumber = 1) as other from lineitem group by 1), v as (select *, case when dup <= 12 then dup else 0 end as d, case when other <= least(4, n // 3) then other else 0 end as o from g) select l_suppkey, n, case when n - d - o < 5 then 0 else d end as dropped_duplicates, case when n - d - o < 5 then 0 else o end as dropped_others from v")
def val_drop_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-07: a class of drops over its cap is void as a whole; all are if too few rows would stay."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("dup"), F.count_if(F.expr("l_returnflag = 'A' and l_linenumber = 1")).alias("other"))
    capped = counts.selectExpr("l_suppkey", "n", "if(dup <= 12, dup, 0) as d", "if(other <= least(4, n div 3), other, 0) as o")
    return capped.selectExpr("l_suppkey", "n", "if(n - d - o < 5, 0, d) as dropped_duplicates", "if(n - d - o < 5, 0, o) as dropped_others")


#: rule, since when, condition that fails
_DATED = [("no_title", "2024-01-01", "title = ''"), ("short", "2024-01-10", "length(content) < 200"), ("no_source", "2024-01-20", "source is null"), ("no_country", "2024-01-25", "country is null")]


@query(f"with {ARTICLES_SQL} select id, list_filter([" + ", ".join(f"case when published_at >= timestamp '{d} 00:00:00' and ({c}) then '{r}' end" for r, d, c in _DATED) + "], lambda x: x is not null)[1] as first_failing from articles")
def val_dated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-16, EVD-08 and a part of VAL-06, VAL-10: ordered rules, each in force from its own day; four of theirs are built."""
    reasons: Column = F.array_compact(F.array(*(F.when(F.expr(f"published_at >= timestamp_ntz'{d} 00:00:00' and ({c})"), F.lit(r)) for r, d, c in _DATED)))
    return articles(spark, sf_dir).select("id", F.get(reasons, 0).alias("first_failing"))
