"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import amount, bigrams, jaccard, normalized
from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import identity_keys
from .registry import query

TRACKED = "^(utm_[a-z]+|fbclid|gclid|yclid|_ga|ref|spm)="


def canonical_sql(url: str) -> str:
    bare = f"regexp_replace(trim(coalesce({url}, '')), '#.*$', '')"
    rest = f"regexp_replace({bare}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(www\\.)?', '')"
    path = f"regexp_replace(regexp_replace({rest}, '\\?.*$', ''), '/+$', '')"
    kept = f"list_sort(list_transform(list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), lambda p: p != '' and not regexp_matches(p, '{TRACKED}')), lambda p: url_decode(p)))"
    return f"lower(regexp_extract({path}, '^([^/]*)', 1)) || regexp_replace({path}, '^[^/]*', '') || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"


TITLE_KEY_SQL = "case when length(regexp_replace(regexp_replace(lower(title), '<[^>]*>', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) < 10 then '' else regexp_replace(regexp_replace(lower(title), '<[^>]*>', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g') end"
NORM_SQL = "array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '<[^>]*>', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g')), ' ')[1:120], ' ')"
GRAMS_SQL = "list_distinct(list_transform(range(1, length(replace({x}, ' ', ''))), lambda i: substr(replace({x}, ' ', ''), i, 2)))"


@query(f"with {ARTICLES_SQL} select id, {canonical_sql('url')} as url_key, {TITLE_KEY_SQL} as title_key from articles")
def str_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-01, STR-06, URL-01, SRC-18: address and title keys."""
    return identity_keys(articles(spark, sf_dir)).select("id", "url_key", "title_key")


@query(f"select page_id, {canonical_sql('url')} as url_key from pages")
def url_canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-01 on real addresses."""
    from ..functions.text import canonical_url

    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("url_key"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|fbclid|gclid|_ga)=[^&]*', '\\1', 'g'), '[?&]+$', '') as source_key from pages")
def url_story_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-02: another rule, which keeps scheme and path."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "([?&])(utm_[a-z]+|fbclid|gclid|_ga)=[^&]*", "$1"), "[?&]+$", "")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("source_key"))


@query(f"with {ARTICLES_SQL}, n as (select id, {NORM_SQL.format(x='content')} as norm from articles) select id, norm, length(norm) as n_chars from n")
def str_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: normalised text."""
    norm = normalized(F.col("content"))
    return articles(spark, sf_dir).select("id", norm.alias("norm"), F.length(norm).cast("long").alias("n_chars"))


@query(f"""with {ARTICLES_SQL}, n as (select id, {NORM_SQL.format(x='title')} as t, {NORM_SQL.format(x='content')} as c from articles),
g as (select id, {GRAMS_SQL.format(x='t')} as gt, {GRAMS_SQL.format(x='c')} as gc from n where length(replace(t, ' ', '')) > 1 and length(replace(c, ' ', '')) > 1)
select id, round(len(list_intersect(gt, gc)) / (len(gt) + len(gc) - len(list_intersect(gt, gc))), 9) as sim from g""")
def str_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, STR-03, SET-07: bigram similarity of a title and its text."""
    rows = articles(spark, sf_dir).select("id", normalized(F.col("title")).alias("t"), normalized(F.col("content")).alias("c"))
    long_enough = (F.length(F.replace("t", F.lit(" "), F.lit(""))) > 1) & (F.length(F.replace("c", F.lit(" "), F.lit(""))) > 1)
    return rows.filter(long_enough).select("id", F.round(jaccard(bigrams(F.col("t")), bigrams(F.col("c"))), 9).alias("sim"))


@query(f"with {ARTICLES_SQL}, c as (select id, list_distinct(string_split(title, '')) as a, list_distinct(string_split(content, '')) as b from articles where length(title) > 0) select id, len(list_intersect(a, b)) / greatest(len(a), len(b)) as overlap from c")
def str_title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: character-set overlap."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    a, b = chars(F.col("title")), chars(F.col("content"))
    return articles(spark, sf_dir).filter(F.length("title") > 0).select("id", (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).alias("overlap"))


_SENTENCE = "[^.!?]+[.!?]"


@query(f"with {ARTICLES_SQL}, s as (select id, unnest(regexp_extract_all(content, '{_SENTENCE}')) as s, generate_subscripts(regexp_extract_all(content, '{_SENTENCE}'), 1) as pos from articles), k as (select id, regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]', '', 'g') as k, pos from s), f as (select id, k, min(pos) as first, count(*) as n from k where length(k) >= 10 group by all) select id, count(*) as sentences, cast(sum(n - 1) as bigint) as repeated from f group by id")
def str_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-14, WIN-06: sentences by key, the first of each kept; how many are repeats."""
    # the end of the text ends a match too, so that a long text without signs is read once and not from every place
    s = articles(spark, sf_dir).select("id", F.explode(F.regexp_extract_all("content", F.lit("[^.!?]+([.!?]|$)"), F.lit(0))).alias("s")).filter(F.right("s", F.lit(1)).isin(".", "!", "?"))
    keyed = s.select("id", F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}]", "").alias("k")).filter(F.length("k") >= 10)
    return keyed.groupBy("id", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("n") - 1).alias("repeated"))


@query(f"with {ARTICLES_SQL} select id, regexp_replace(regexp_replace(title, ' [-–|] [^-–|]*$', ''), ' *[(](photo|video)[)]$', '') as stripped, case when len(regexp_extract_all(content, '[а-яА-Я]')) > 20 then 'cyrillic' when len(regexp_extract_all(content, '[一-龥]')) > 10 then 'cjk' when len(regexp_extract_all(content, '[a-zA-Z]')) > 0 then 'latin' else 'other' end as script from articles")
def str_script_and_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08, STR-20: titles without source suffixes; the script of a text."""
    count = lambda p: F.regexp_count("content", F.lit(p))
    script = F.when(count("[а-яА-Я]") > 20, "cyrillic").when(count("[一-龥]") > 10, "cjk").when(count("[a-zA-Z]") > 0, "latin").otherwise("other")
    return articles(spark, sf_dir).select("id", F.regexp_replace(F.regexp_replace("title", " [-–|] [^-–|]*$", ""), " *[(](photo|video)[)]$", "").alias("stripped"), script.alias("script"))


@query(f"with {ARTICLES_SQL} select id, case when country is null or source is null then null else split_part(lower(country), '-', 1) = split_part(lower(case when id % 3 = 0 then 'EN-us' else country end), '-', 1) end as matches from articles")
def str_language_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21: base languages compared; unknown is null, not false."""
    other = F.when(F.col("id") % 3 == 0, "EN-us").otherwise(F.col("country"))
    base = lambda c: F.split_part(F.lower(c), F.lit("-"), F.lit(1))
    return articles(spark, sf_dir).select("id", F.when(F.col("country").isNotNull() & F.col("source").isNotNull(), base(F.col("country")) == base(other)).alias("matches"))


_AMOUNT = "case when p_partkey % 3 = 0 then replace(printf('%.2f', p_retailprice), '.', ',') when p_partkey % 3 = 1 then printf('%,.0f', p_retailprice) else printf('%.1f', p_retailprice) end"


@query("with a as (select p_partkey, case p_partkey % 3 when 0 then p_size || ',5' when 1 then p_size || ',' || '250' else p_size || '.75' end as raw from part) select p_partkey, raw, try_cast(replace(regexp_replace(raw, ',(\\d{1,2})$', '.\\1'), ',', '') as double) as value from a")
def num_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-01: amounts with a comma or a point."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(",5"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_size", F.lit(",250"))).otherwise(F.concat("p_size", F.lit(".75")))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", amount(F.col("raw")).alias("value"))


@query("with s as (select l_orderkey, l_linenumber, l_quantity as v, l_quantity * case l_linenumber % 4 when 0 then 10 when 1 then 1 when 2 then 100 else 3 end as w from lineitem where l_quantity > 0) select l_orderkey, l_linenumber, abs(log10(w / v) - round(log10(w / v))) < 0.02 and round(log10(w / v)) != 0 as mismatch from s")
def num_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-02, NUM-03, NUM-06: two amounts that differ by a power of ten."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", F.log10(F.expr("l_quantity * case l_linenumber % 4 when 0 then 10 when 1 then 1 when 2 then 100 else 3 end") / F.col("l_quantity")).alias("ratio"))
    return rows.select("l_orderkey", "l_linenumber", ((F.abs(F.col("ratio") - F.rint("ratio")) < 0.02) & (F.rint("ratio") != 0)).alias("mismatch"))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d') as beijing_date, strftime(time_bucket(interval '1 day', ts, timestamp '2000-01-01 22:00:00'), '%Y-%m-%d %H:%M') as window_start, cast(extract(hour from ts) * 60 + extract(minute from ts) as int) as minute_of_day, extract(hour from ts) between 5 and 9 as in_recovery from events")
def dt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-01, 02, 03, 07, STM-01 in batch: the local date and the 24-hour issue window of each event."""
    ts = F.col("ts").cast("timestamp_ntz")
    start = F.expr("date_trunc('DAY', ts + interval 2 hours) - interval 2 hours")
    minute = F.hour(ts) * 60 + F.minute(ts)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts + F.expr("interval 8 hours"), "yyyy-MM-dd").alias("beijing_date"), F.date_format(start, "yyyy-MM-dd HH:mm").alias("window_start"), minute.alias("minute_of_day"), F.hour(ts).between(5, 9).alias("in_recovery"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(try_cast(json_extract_string(props, '$.k') as bigint) between 1 and 60, false) as in_range from events")
def js_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS-04, JS-06: answers in JSON, read by a schema; what can't be read is null."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k.between(1, 60), F.lit(False)).alias("in_range"))


@query(f"with {ARTICLES_SQL}, n as (select id, list_distinct(regexp_extract_all(content, '[0-9]+')) as body, list_distinct(regexp_extract_all(title, '[0-9]+')) as orig, list_distinct(regexp_extract_all(lower(content), '[a-z]{{4,}}')) as w, list_distinct(regexp_extract_all(lower(title), '[a-z]{{4,}}')) as v from articles) select id, len(list_filter(body, lambda x: not list_contains(orig, x))) as extra_numbers, len(list_filter(w, lambda x: not list_contains(v, x))) as extra_words from n")
def set_extra_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06, SET-08, EV-15: numbers and words of a text that its title doesn't have."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    numbers = F.array_except(found("content", "[0-9]+"), found("title", "[0-9]+"))
    words = F.array_except(found(F.lower("content"), "[a-z]{4,}"), found(F.lower("title"), "[a-z]{4,}"))
    return articles(spark, sf_dir).select("id", F.size(numbers).cast("long").alias("extra_numbers"), F.size(words).cast("long").alias("extra_words"))


@query(f"with {ARTICLES_SQL} select id, regexp_matches(content, '[0-9]{{4}}') as has_time, regexp_matches(content, '[0-9]') as has_number, length(title) > 42 as long_title, regexp_matches(content, '(?i)translator.s note|as an ai') as meta_comment, case when title = '' then 'no_title' when length(content) < 60 then 'short' when regexp_matches(content, '[0-9]') then null else 'no_data' end as first_failing from articles")
def val_article_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-08, 15, STR-16, STR-22 and one of VAL-01's ten issue kinds: rule columns and the first failing rule."""
    c = F.col("content")
    first = F.when(F.col("title") == "", "no_title").when(F.length(c) < 60, "short").when(c.rlike("[0-9]"), None).otherwise("no_data")
    return articles(spark, sf_dir).select("id", c.rlike("[0-9]{4}").alias("has_time"), c.rlike("[0-9]").alias("has_number"), (F.length("title") > 42).alias("long_title"), c.rlike("(?i)translator.s note|as an ai").alias("meta_comment"), first.alias("first_failing"))
