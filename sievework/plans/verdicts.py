"""Amounts in texts, judged pairs and groups, samples for annotation, and dated rules."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.amounts import magnitude_mismatches, scaled_amounts
from ..operators.dated_rules import broken_rules, first_broken, rule_table
from ..operators.judging import cluster_report, judged_groups, judged_pairs, opposite
from ..operators.similarity import components, similar_pairs
from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import DOWN_WORDS, UP_WORDS, _any_sql
from .joins import FLOOR, PAIRS_SQL
from .registry import query

#: Words of scale of both sides, as a run's table holds them.
UNITS = [("billion", 1e9), ("million", 1e6), ("thousand", 1e3), ("млрд", 1e9), ("миллиард", 1e9), ("млн", 1e6), ("миллион", 1e6), ("тыс", 1e3)]
SCALES = [("亿", 1e8), ("万", 1e4)]
#: Two texts rendered from an order: its total in a unit by its key, and the same in another script, some with a wrong scale.
_ORIGINAL = "concat('Total of ', format_string('%d', cast(round(o_totalprice) as bigint)), if(o_orderkey % 2 = 0, ' million', ' млрд'), ' and ', cast(o_custkey as string), ' thousand more.')"
_SCALE = "case when o_orderkey % 2 = 0 then 0.01 else 10 end * case when o_orderkey % 7 = 0 then 10 when o_orderkey % 11 = 0 then 0.1 else 1 end"
_TRANSLATED = f"concat('共', regexp_replace(cast(cast(round(o_totalprice) * ({_SCALE}) as decimal(20, 3)) as string), '[.]?0+$', ''), '亿, ', regexp_replace(cast(cast(o_custkey * 0.1 as decimal(20, 1)) as string), '[.]0$', ''), '万')"


@query("""with o as (select o_orderkey as id, round(o_totalprice) as n, case when o_orderkey % 2 = 0 then 1e6 else 1e9 end as u, case when o_orderkey % 7 = 0 then 10 when o_orderkey % 11 = 0 then 0.1 else 1 end as e, o_custkey as m from orders),
v as (select id, n * u as a, n * u * e as b, cast(cast(n as bigint) as varchar) as da, m * 1e3 as c, cast(m as varchar) as dc,
  regexp_replace(regexp_replace(cast(cast(n * case when u = 1e6 then 0.01 else 10 end * e as decimal(20, 3)) as varchar), '[.]?0+$', ''), '[.]', '', 'g') as db, regexp_replace(regexp_replace(cast(cast(m * 0.1 as decimal(20, 1)) as varchar), '[.]0$', ''), '[.]', '', 'g') as dd from o),
p as (select id, 0 as k, a as x, unnest([struct_pack(y := b, d := db, j := 0), struct_pack(y := c, d := dd, j := 1)]) as t, da as dx from v union all select id, 1, c, unnest([struct_pack(y := b, d := db, j := 0), struct_pack(y := c, d := dd, j := 1)]), dc from v),
q as (select id, k, x, arg_min(t.y, (abs(t.y - x), t.j)) as y from p where starts_with(dx, t.d) or starts_with(t.d, dx) group by id, k, x)
select id, count(*) as mismatches, round(max(y / x), 6) as ratio from q where abs(log10(y / x) - round(log10(y / x))) < 0.02 and round(log10(y / x)) != 0 group by id""")
def num_text_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-02, NUM-03, NUM-06: amounts of one text whose nearest amount with the same digits in the other is off by a power of ten."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_ORIGINAL).alias("original"), F.expr(_TRANSLATED).alias("translated"))
    one = scaled_amounts(orders.select("id", F.col("original").alias("text")), spark.createDataFrame(UNITS, "word string, scale double"))
    two = scaled_amounts(orders.select("id", F.col("translated").alias("text")), spark.createDataFrame(SCALES, "word string, scale double"))
    found = magnitude_mismatches(one, two)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("mismatches"), F.round(F.max("ratio"), 6).alias("ratio"))


def reference_judge(asked: list[dict]) -> str:
    """A judge by rule: the same where titles are nearly alike. It has no answer for one scope and chats around the others."""
    if asked[0]["scope"] == "es":
        raise TimeoutError("no answer")
    return f"Here you are: ```json {json.dumps({'same': [x['n'] for x in asked if x['sim'] >= 0.93] + [9999]})} ```"


_VETO_SQL = f"(({_any_sql('x.title', UP_WORDS)} and not {_any_sql('x.title', DOWN_WORDS)} and {_any_sql('y.title', DOWN_WORDS)} and not {_any_sql('y.title', UP_WORDS)}) or ({_any_sql('y.title', UP_WORDS)} and not {_any_sql('y.title', DOWN_WORDS)} and {_any_sql('x.title', DOWN_WORDS)} and not {_any_sql('x.title', UP_WORDS)}))"
_JUDGED_SQL = f"{PAIRS_SQL}, judged as (select a, b, sim, case when {_VETO_SQL} then 'veto' when x.country = 'es' then 'failed' when sim >= 0.97 then 'same' when sim >= 0.93 then 'below_floor' else 'different' end as verdict from pairs join articles x on x.id = a join articles y on y.id = b)"
JUDGED_FLOOR = 0.97


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).filter("country is not null")
    side = lambda s: rows.select(F.col("id").alias(s), F.col("title").alias(f"title_{s}"), *([F.col("country").alias("scope")] if s == "a" else []))
    pairs = similar_pairs(rows.select("id", F.col("country").alias("block"), "title"), FLOOR).join(side("a"), "a").join(side("b"), "b")
    return judged_pairs(pairs, reference_judge, opposite(F.col("title_a"), F.col("title_b"), UP_WORDS, DOWN_WORDS), floor=JUDGED_FLOOR)


@query(f"with {_JUDGED_SQL} select a, b, verdict from judged")
def dd_judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-07, JS-04, FLT-11, FLT-14: pairs through polarity veto, a judge asked in blocks, and a floor; a failed block merges nothing."""
    return _judged(spark, sf_dir).select("a", "b", "verdict")


def letter_judge(asked: list[dict]) -> str:
    """Groups of titles with the same first word."""
    groups: dict[str, list[int]] = {}
    for x in asked:
        groups.setdefault(x["title"].split(" ")[0].lower(), []).append(x["n"])
    return f'Found: {json.dumps({"groups": [*groups.values(), "?", [7, 7]]})}.'


@query()
def dd_judged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-07, JS-04: groups that a judge sees in blocks of a country's titles, as components of their members."""
    rows = articles(spark, sf_dir).filter("country is not null and title != ''").select(F.col("country").alias("scope"), "id", "title")
    return components(judged_groups(rows, letter_judge))


@query(f"with {_JUDGED_SQL}, s as (select 'fuzzy' as band, a, b, round(sim, 9) as sim, row_number() over (order by sim desc, a, b) as place from judged where sim < 0.95 union all select 'declined', a, b, round(sim, 9), row_number() over (order by sim desc, a, b) from judged where verdict in ('different', 'below_floor', 'veto')) select band, a, b, sim, place from s where place <= case band when 'fuzzy' then 12 else 8 end")
def top_annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-09: the most alike pairs of the fuzzy band and of those declined, twelve and eight, for annotation."""
    told = _judged(spark, sf_dir)
    # a limit on an order keeps so many rows a task; the few rows left are numbered
    best = lambda rows, band, n: rows.orderBy(F.desc("sim"), "a", "b").limit(n).select(F.lit(band).alias("band"), "a", "b", "sim")
    both = best(told.filter("sim < 0.95"), "fuzzy", 12).union(best(told.filter("verdict in ('different', 'below_floor', 'veto')"), "declined", 8))
    place = F.expr("row_number() over (partition by band order by sim desc, a, b)")
    return both.select("band", "a", "b", F.round("sim", 9).alias("sim"), place.alias("place"))


@query(f"with recursive {PAIRS_SQL}, ways as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as root from ways union select ways.b, root from reach join ways on ways.a = reach.id and root < ways.b), c as (select id, min(root) as root from reach group by id), e as (select c.root, l.quality = m.quality as same from pairs p join c on c.id = p.a left join labels l on l.doc_id = p.a left join labels m on m.doc_id = p.b), n as (select root, count(*) as size from c group by root) select e.root, size, count(*) as edges, round(count(*) * 2 / (size * (size - 1)), 9) as density, count(*) filter (where same) as real, count(*) filter (where not same) as false_merges, count(*) filter (where same is null) as unknown from e join n on n.root = e.root group by e.root, size")
def ev_cluster_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-08: real and false merges of each cluster by the labels, and how dense its edges are."""
    rows = articles(spark, sf_dir).select("id", F.col("country").alias("block"), "title").filter("block is not null")
    pairs = similar_pairs(rows, FLOOR)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("event"))
    out = cluster_report(pairs, components(pairs), labels)
    return out.select("root", "size", "edges", F.round("density", 9).alias("density"), "real", F.col("false").alias("false_merges"), "unknown")


def _day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


#: (rule, version, kind, field, value, scope, effective_from, severity): a run's rule table. A later version ends the one before.
PACKAGE_RULES = [
    ("title_missing", 1, "missing", "title", None, None, "2023-01-01", 9), ("source_missing", 1, "missing", "source", None, None, "2023-01-01", 9), ("country_missing", 1, "missing", "country", None, None, "2023-01-01", 8),
    ("body_missing", 1, "missing", "body", None, None, "2023-01-01", 9), ("title_short", 1, "shorter", "title", "8", None, "2023-01-01", 4), ("title_short", 2, "shorter", "title", "12", None, "2024-01-10", 4),
    ("title_long", 1, "longer", "title", "120", None, "2023-01-01", 3), ("title_long", 2, "longer", "title", "90", None, "2024-01-08", 3), ("title_long", 3, "longer", "title", "70", None, "2024-01-20", 3),
    ("body_short", 1, "shorter", "body", "60", None, "2023-01-01", 7), ("body_short", 2, "shorter", "body", "200", None, "2024-01-15", 7), ("body_long", 1, "longer", "body", "60000", None, "2023-01-01", 2),
    ("title_end", 1, "lacks", "title", "[.!?]$", None, "2023-01-01", 1), ("title_end", 2, "matches", "title", "[.!?]$", None, "2024-01-12", 1), ("title_digits", 1, "matches", "title", "[0-9]{5,}", None, "2023-01-01", 5),
    ("title_marks", 1, "matches", "title", "[%#$*&]{2,}", None, "2023-01-01", 6), ("title_space", 1, "matches", "title", "  |^ | $", None, "2023-01-01", 2), ("title_caps", 1, "lacks", "title", "^[A-ZÀ-Þ]", None, "2024-01-05", 1),
    ("body_marks", 1, "matches", "body", "[%#$*&]{3,}", None, "2023-01-01", 5), ("body_number", 1, "lacks", "body", "[0-9]", None, "2024-01-18", 2), ("body_address", 1, "matches", "body", "[a-z0-9.]+@[a-z0-9]+[.][a-z]+", None, "2023-01-01", 8),
    ("body_phone", 1, "matches", "body", "[+][0-9]{1,3} [(]?[0-9]{3}", None, "2023-01-01", 8), ("body_token", 1, "matches", "body", "(token|password|secret) *[=:]", None, "2024-01-03", 9), ("body_period", 1, "lacks", "body", "[.!?]", None, "2023-01-01", 3),
    ("url_secure", 1, "lacks", "url", "^https://", None, "2023-01-01", 6), ("url_tracking", 1, "matches", "url", "[?&]utm_", None, "2023-01-01", 2), ("url_tracking", 2, "retired", "url", None, None, "2024-01-22", 0),
    ("url_fragment", 1, "matches", "url", "#", None, "2024-01-06", 1), ("url_www", 1, "matches", "url", "//www[.]", "en", "2024-01-09", 1), ("de_umlaut", 1, "lacks", "body", "[äöüß]", "de", "2023-01-01", 3),
    ("fr_accent", 1, "lacks", "body", "[éèêç]", "fr", "2023-01-01", 3), ("es_tilde", 1, "lacks", "body", "[áéíóúñ]", "es", "2023-01-01", 3), ("category_sports", 1, "matches", "category", "^sports$", None, "2024-01-16", 2),
    ("source_country", 1, "differs", "source", "country", "en", "2024-01-25", 1), ("word_lorem", 1, "holds", "body", "lorem", None, "2023-01-01", 6), ("word_license", 1, "holds", "body", "license", None, "2023-01-01", 4),
    ("word_license", 2, "holds", "body", "copyright", None, "2024-01-14", 4), ("word_and", 1, "wants", "body", " and ", "en", "2023-01-01", 2), ("word_und", 1, "wants", "body", " und ", "de", "2024-01-11", 2),
]


def _package_sql() -> str:
    later, out = {}, []
    for r in sorted(PACKAGE_RULES, key=lambda r: (r[0], r[6]), reverse=True):
        rule, version, kind, field, value, scope, since, severity = r
        until, later[rule] = later.get(rule), since
        if kind == "retired":
            continue
        text = f"coalesce(cast({field} as varchar), '')"
        broken = {
            "missing": f"trim({text}) = ''", "shorter": f"length({text}) < {value}", "longer": f"length({text}) > {value}", "matches": f"regexp_matches({text}, '{value}')", "lacks": f"not regexp_matches({text}, '{value}')",
            "holds": f"contains(lower({text}), '{value}')", "wants": f"not contains(lower({text}), '{value}')", "differs": f"{field} is distinct from {value} or {field} is null",
        }[kind]
        holds = [f"day >= date '{since}'"] + ([f"day < date '{until}'"] if until else []) + ([f"country = '{scope}'"] if scope else [])
        out.append(f"select id, '{rule}' as rule, {version} as version, {severity} as severity from packages where {' and '.join(holds)} and ({broken})")
    return f"{ARTICLES_SQL}, packages as (select *, content as body, cast(published_at as date) as day from articles), broken as ({' union all '.join(out)})"


_PACKAGE_SQL = _package_sql()


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumns({"body": F.col("content"), "day": F.to_date("published_at")})
    return broken_rules(rows, rule_table(spark, [(*r[:6], _day(r[6]), r[7]) for r in PACKAGE_RULES]), "id", "day", "country")


@query(f"with {_PACKAGE_SQL} select id, rule, version, severity from broken")
def val_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-02, VAL-05, VAL-10, VAL-15, EVD-08: a row for each rule that a package breaks, by the version of the rule on its day."""
    return _broken(spark, sf_dir)


@query(f"with {_PACKAGE_SQL} select id, arg_min(rule, (-severity, rule)) as rule, count(*) as broken from broken group by id")
def val_first_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-06, VAL-16: each package's gravest broken rule and how many it breaks."""
    return first_broken(_broken(spark, sf_dir), "id")
