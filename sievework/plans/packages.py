"""Drafts, packages, originals and ledgers: what an editor hands over, bound to what was collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts as D
from ..operators import originals as O
from ..sources.tables import ARTICLES_SQL, articles, table
from .registry import query

#: Names of sections and their codes.
SECTIONS = [("English", "en"), ("Deutsch", "de"), ("Español", "es"), ("Français", "fr")]
_FIELD_SQL = "|".join(D.SOURCE_LABELS)
_NAME_SQL = "case country " + " ".join(f"when '{c}' then '{n}'" for n, c in SECTIONS) + " end"
#: A document written as a draft: a head, the title (numbered in three of five categories), the text, its source and day.
_DRAFT_SQL = f"""concat_ws(chr(10), '## ' || {_NAME_SQL} || ' daily', case when category in ('economy', 'energy', 'culture') then '1. ' || title else title end, content, 'Source: ' || source || ', ' || strftime(published_at, '%Y-%m-%d'))"""
_PLACED_SQL = f"""{ARTICLES_SQL}, d as (select id, string_split({_DRAFT_SQL}, chr(10)) as l from articles),
raw as (select id, unnest(l) as line, generate_subscripts(l, 1) - 1 as n from d), t as (select id, n, trim(line) as line from raw),
h as (select *, regexp_extract(line, '^## ([^ ]+) daily$', 1) as head, regexp_extract(line, '(?i)^(?:{_FIELD_SQL})\\s*[:：]\\s*(\\S.*)$', 1) as source, trim(regexp_replace(regexp_extract(line, '^([0-9]{{1,2}})\\s*[.)]?\\s*(\\S.*)$', 2), '[*]{{2,}}', '', 'g')) as numbered from t),
k as (select *, case when head in ({', '.join(f"'{n}'" for n, _ in SECTIONS)}) then 'head' when line = '' then 'empty' when source != '' then 'field' when numbered != '' and length(numbered) <= {D.TITLE_CHARS} then 'item' else 'prose' end as kind from h),
s as (select *, count(*) filter (where kind = 'head') over (partition by id order by n) as section_no from k),
o as (select *, kind = 'item' or (kind = 'prose' and length(line) <= {D.SHORT_CHARS} and section_no > 0) as opens from s),
b as (select *, coalesce(bool_or(opens) over (partition by id, section_no order by n rows between unbounded preceding and 1 preceding), false) as seen from o),
p as (select *, kind = 'item' or (opens and not seen) as starts from b),
placed as (select *, case when (seen or starts) and kind not in ('head', 'empty') then count(*) filter (where starts) over (partition by id order by n) end as item from p)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame(SECTIONS, "name string, code string")
    name = F.expr("case country " + " ".join(f"when '{c}' then '{n}'" for n, c in SECTIONS) + " end")
    title = F.when(F.col("category").isin("economy", "energy", "culture"), F.concat(F.lit("1. "), "title")).otherwise(F.col("title"))
    text = F.concat_ws("\n", F.concat(F.lit("## "), name, F.lit(" daily")), title, "content", F.concat(F.lit("Source: "), "source", F.lit(", "), F.date_format("published_at", "yyyy-MM-dd")))
    lines = articles(spark, sf_dir).select(F.col("id").alias("doc"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return D.placed_lines(lines, sections)


@query(f"""with {_PLACED_SQL}
select id, item, item as number, coalesce(max(country), 'none') as section, max(case when kind = 'item' then numbered else line end) filter (where starts) as title, md5(coalesce(string_agg(line, chr(10) || chr(10) order by n) filter (where kind = 'prose' and not starts), '')) as body_md5,
  arg_max(placed.source, n) filter (where placed.source != '') as source, arg_min(regexp_extract(line, '{D.DATE}', 0), n) filter (where not starts and regexp_matches(line, '{D.DATE}')) as published
from placed join (select id, country from articles) using (id) where item is not null group by id, item""")
def ext_draft_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: drafts as items with their section, number, title, body, source and first date."""
    items = D.draft_items(_placed(spark, sf_dir), "none")
    return items.select(F.col("doc").alias("id"), "item", F.col("number").cast("long").alias("number"), "section", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "source", "published")


@query(f"with {_PLACED_SQL} select id, n, case when kind = 'field' then 'field_without_item' else 'prose_without_item' end as warning, substr(line, 1, 30) as line from placed where item is null and kind in ('field', 'prose')")
def ext_draft_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: lines of drafts that no item takes."""
    return D.draft_warnings(_placed(spark, sf_dir)).withColumnRenamed("doc", "id")


_ISSUE_SQL = f"strftime(published_at + interval '1 day' + interval '{O.OFFSET_HOURS - O.END_HOUR} hours', '%Y-%m-%d')"
_PACKED_SQL = f"{ARTICLES_SQL}, packed as (select a.*, {_ISSUE_SQL} as issue, concat_ws('/', {_ISSUE_SQL}, country, source) as package, coalesce(toxic = 1, false) as taken_out from articles a left join (select doc_id, max(toxic) as toxic from labels group by 1) l on l.doc_id = a.id)"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in the package of their issue, country and source; toxic ones were taken out by the writer."""
    toxic = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = articles(spark, sf_dir).withColumn("issue", O.issue_of(F.col("published_at")))
    return rows.withColumn("package", F.concat_ws("/", "issue", "country", "source")).join(toxic, "id", "left").withColumn("taken_out", F.coalesce(F.col("toxic") == 1, F.lit(False)))


def _digest_sql(where: str) -> str:
    return f"select package, count(*) as n, sha256(string_agg(id || ':' || sha256(content), chr(10) order by id)) as digest from packed where {where} group by package"


@query(f"""with {_PACKED_SQL}, whole as ({_digest_sql('true')}), written as ({_digest_sql('not taken_out')}),
ends as (select package, max(published_at) as last, max(issue) as issue from packed group by package)
select package, whole.n, case when hour(last) >= 21 and last < cast(issue as date) - interval '{O.OFFSET_HOURS - O.END_HOUR} hours' - interval '30 minutes' then 'window' when written.package is null then 'not_final' when whole.n > {O.MOST} then 'count' when whole.digest != written.digest then 'hash' end as error
from whole join ends using (package) left join written using (package)""")
def evd_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-05: packages against their issue's window, their size and the writer's hash. A package whose last article came in the
    hour before the last half hour states a window that ends with the hour; the writer's hash leaves toxic articles out."""
    rows = _packed(spark, sf_dir)
    written = O.package_digests(rows.filter("not taken_out").select("package", "id", F.col("content").alias("text"))).select("package", F.col("digest").alias("body_hash"), F.lit(True).alias("ready"), F.lit("writer").alias("writer"))
    ends = rows.groupBy("package").agg(F.max("issue").alias("issue"), F.max("published_at").alias("last"))
    end = O.issue_end(F.col("issue"))
    early = (F.hour("last") >= 21) & (F.col("last") < end - F.expr("interval '30' minute"))
    stated = F.when(early, F.date_trunc("hour", "last").cast("timestamp_ntz")).otherwise(end)
    packages = ends.join(written, "package", "left").select("package", "issue", (end - F.expr("interval '1' day")).alias("window_start"), stated.alias("window_end"), "ready", "writer", "body_hash")
    return O.handoff_errors(packages, rows.select("package", "id", F.col("content").alias("text")))


_PATH_SQL = "regexp_extract(url, '(/story/[0-9]+)', 1)"


@query(f"""with {_PACKED_SQL}, p as (select *, {_PATH_SQL} as path from packed), firsts as (select path, min(id) as id from p group by path), lasts as (select path, arg_max(content, id) as content, arg_max(title, id) as title from p group by path),
ledger as (select f.id, length(content) >= 200 as validated, title, path, content from firsts f join p using (id, path)), kept as (select * from lasts where title != ''),
sizes as (select package, count(*) as n from p group by package)
select p.package as request, p.id, case when n > {O.ASKED} then 'request' when l.id is null then 'not_in_ledger' when not validated then 'not_validated' when i.title != l.title then 'evidence_changed' when k.path is null then 'archive_missing' when k.content != l.content then 'file_changed' end as error
from p join sizes using (package) left join ledger l on l.id = p.id left join lasts i on i.path = l.path left join kept k on k.path = l.path""")
def evd_bound_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-03, EVD-07: originals asked for by package, bound by three hashes. An address that was read again has the later text in
    the archive and in the index; its ledger row is that of the first reading."""
    rows = _packed(spark, sf_dir).withColumn("path", F.regexp_extract("url", "(/story/[0-9]+)", 1))
    first = rows.groupBy("path").agg(F.min("id").alias("id"))
    last = rows.groupBy("path").agg(F.max("id").alias("id"))
    text_hash, fingerprint = F.sha2("content", 256), F.sha2("title", 256).alias("fingerprint")
    ledger = rows.join(first, ["path", "id"], "left_semi").select("id", (F.length("content") >= 200).alias("validated"), fingerprint, "path", text_hash.alias("file_hash"), text_hash.alias("text_hash"))
    again = rows.join(last, ["path", "id"], "left_semi").select("path", "title", "content")
    index = first.join(again, "path").select("id", fingerprint)
    archive = again.filter("title != ''").select("path", F.col("content").alias("raw"), F.col("content").alias("text"))
    return O.bound_originals(rows.select(F.col("package").alias("request"), "id"), ledger, index, archive)


_LEDGER_SQL = f"""{ARTICLES_SQL}, copies as (select min(id) as id from articles group by content), marks as (select doc_id as id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
ledger as (select a.id, a.content, {_PATH_SQL} as path, published_at, case when toxic = 1 then 'rejected' when quality = 1 then 'selected' when quality = 0 then 'rejected' else 'pending' end as decision, case when toxic = 1 then 'toxic' when quality is not null then 'quality' end as reason, quality = 1 as disclosed, quality is not null as decided from articles a left join marks m using (id)),
adopted as (select id, path from ledger join copies using (id) where disclosed and reason = 'quality')"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries without decisions, two passes of decisions (quality, then toxicity), and the adopted ones: selected, no exact copy."""
    rows = articles(spark, sf_dir).select("id", "content", "published_at", F.regexp_extract("url", "(/story/[0-9]+)", 1).alias("path"))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    quality = marks.select(F.col("id").alias("event"), F.lit(1).alias("at"), F.lit(0).alias("seq"), F.when(F.col("quality") == 1, "selected").otherwise("rejected").alias("decision"), F.lit("quality").alias("reason"), (F.col("quality") == 1).alias("disclosed"))
    toxic = marks.filter("toxic = 1").select(F.col("id").alias("event"), F.lit(2).alias("at"), F.lit(0).alias("seq"), F.lit("rejected").alias("decision"), F.lit("toxic").alias("reason"), (F.col("quality") == 1).alias("disclosed"))
    first = rows.groupBy(F.sha2("content", 256).alias("h")).agg(F.min("id").alias("id"))
    adopted = rows.join(first, "id", "left_semi").join(marks.filter("quality = 1 and toxic = 0"), "id", "left_semi").select("id", "path")
    return rows, quality.union(toxic), adopted


@query(f"with {_LEDGER_SQL} select l.id, decision, reason, a.id is not null as adopted, case when decided and decision != case when a.id is not null then 'selected' else 'rejected' end then 'selection_mismatch' end as error from ledger l left join adopted a using (id)")
def evd_audit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-06: the latest decisions laid over the ledger; selected if and only if adopted. Exact copies were decided but not adopted."""
    rows, decisions, adopted = _ledger(spark, sf_dir)
    entries = rows.select("id", F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("disclosed"))
    return O.overlaid(entries, decisions, adopted)


@query(f"""with {_LEDGER_SQL}, r as (select distinct path from articles join ledger using (id) where length(articles.content) >= 400)
select 'url_repeated' as kind, path as key from ledger group by path having count(*) > 1
union all select 'adopted_url_repeated', path from adopted group by path having count(*) > 1
union all select 'pending', cast(id as varchar) from ledger where decision = 'pending'
union all select 'discovered_outside', cast(id as varchar) from ledger where published_at not between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-29 00:00:00'
union all select 'selected_without_text', cast(id as varchar) from ledger where decision = 'selected' and length(content) < 200
union all select 'text_without_record', cast(l.id as varchar) from ledger l where length(content) >= 200 and not exists (select 1 from ledger x where x.path = l.path and x.published_at = l.published_at and length(x.content) >= 400)
union all select 'selected_not_adopted', path from (select distinct path from ledger where decision = 'selected') where path not in (select path from adopted)
union all select 'adopted_not_selected', path from (select distinct path from adopted) where path not in (select path from ledger where decision = 'selected')""")
def val_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-14: a ledger's rules: unique ids and addresses, decisions, reasons, times, texts with records, selected as adopted. A
    text is stated from 200 characters on and recorded from 400 on."""
    rows, decisions, adopted = _ledger(spark, sf_dir)
    entries = rows.select("id", F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("disclosed"))
    now = O.overlaid(entries, decisions, adopted).select("id", "decision", "reason")
    stamp = lambda t: F.expr(f"timestamp_ntz'{t} 00:00:00'")
    ledger = rows.join(now, "id").select("id", F.col("path").alias("url"), "decision", "reason", F.col("published_at").alias("discovered_at"), stamp("2024-01-02").alias("start"), stamp("2024-01-29").alias("stop"), F.when(F.length("content") >= 200, F.col("published_at")).alias("text_at"))
    records = rows.filter(F.length("content") >= 400).select(F.col("path").alias("url"), F.col("published_at").alias("at"))
    return O.ledger_errors(ledger, adopted.select("id", F.col("path").alias("url")), records)
