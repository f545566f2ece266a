"""Story deduplication as a chain, what its floors decide, and the writes of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalized
from ..operators.similarity import coded, components, first_seen, similar_pairs
from ..sources.shared import Scratch, new_path, stage
from ..sources.sinks import VersionedTable, write_valid
from ..sources.tables import ARTICLES_SQL, articles, table
from .gates import DOWN_WORDS, UP_WORDS, _any_sql, identity_keys, polarity
from .joins import KEYED_SQL, PAIRS_SQL
from .registry import query
from .scalars import NORM_SQL

LOW_FLOOR, FLOORS, TEXT_FLOOR, TITLE_FLOOR, LIMIT = 0.85, (0.85, 0.9, 0.95, 1.0), 0.8, 0.95, 4
_LOW_SQL = PAIRS_SQL.replace("sim >= 0.9", f"sim >= {LOW_FLOOR}")
PLACEHOLDERS = ("untitled", "no title")


def title_pairs(spark: SparkSession, sf_dir: str, floor: float) -> DataFrame:
    return similar_pairs(articles(spark, sf_dir).select("id", F.col("country").alias("block"), "title").filter("block is not null"), floor)


@query(f"with recursive {_LOW_SQL}, f as (select unnest([{', '.join(map(str, FLOORS))}]) as floor), e as (select cast(floor as double) as floor, a, b from f, pairs where sim >= floor), w as (select floor, a, b from e union select floor, b, a from e), reach as (select floor, a as id, a as root from w union select w.floor, w.b, root from reach join w on w.a = reach.id and w.floor = reach.floor and root < w.b), c as (select floor, id, min(root) as root from reach group by all), g as (select floor, root, count(*) as n from c group by all) select g.floor, any_value(p.pairs) as pairs, count(*) as clusters, count(*) filter (where n > {LIMIT}) as oversize from g join (select floor, count(*) as pairs from e group by 1) p on p.floor = g.floor group by g.floor")
def ev_floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-02, DD-07: pairs, components and oversize components at each of several floors, in one run: a node is (floor, id)."""
    pairs = title_pairs(spark, sf_dir, LOW_FLOOR)
    swept = pairs.select(F.explode(F.expr(f"filter(array({', '.join(f'{f}D' for f in FLOORS)}), f -> sim >= f)")).alias("floor"), "a", "b")
    swept = stage(swept, "swept")
    labels = components(swept.select(F.struct("floor", F.col("a").alias("id")).alias("a"), F.struct("floor", F.col("b").alias("id")).alias("b")))
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select(F.col("root.floor").alias("floor"), "n")
    clusters = sizes.groupBy("floor").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > LIMIT).alias("oversize"))
    return swept.groupBy("floor").agg(F.count(F.lit(1)).alias("pairs")).join(clusters, "floor").select("floor", "pairs", "clusters", "oversize")


@query(f"with {_LOW_SQL} select a, b, case when sim >= 0.9 then 'both' else 'added' end as change from pairs")
def ev_floor_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-04, FLT-14: what a lower floor adds, and what stands at both."""
    return title_pairs(spark, sf_dir, LOW_FLOOR).select("a", "b", F.when(F.col("sim") >= 0.9, "both").otherwise("added").alias("change"))


_POLARITY_SQL = f"case when {_any_sql('title', UP_WORDS)} and not {_any_sql('title', DOWN_WORDS)} then 'up' when {_any_sql('title', DOWN_WORDS)} and not {_any_sql('title', UP_WORDS)} then 'down' else 'none' end"


@query(f"with {PAIRS_SQL}, p as (select id, published_at >= timestamp '2024-01-20 00:00:00' as new, {_POLARITY_SQL} as pol from articles), m as (select x.id, y.id as other from (select a as x, b as y from pairs where sim >= {TITLE_FLOOR} union all select b, a from pairs where sim >= {TITLE_FLOOR}) q join p x on x.id = q.x join p y on y.id = q.y where x.new and not y.new and not (x.pol != y.pol and x.pol != 'none' and y.pol != 'none')) select p.id, min(m.other) as first_match from p left join m on m.id = p.id where p.new group by p.id")
def jn_not_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03: for each new row the first stored one whose title is nearly equal and doesn't say the opposite; null: it is new."""
    rows = articles(spark, sf_dir).select("id", F.expr("published_at >= timestamp_ntz'2024-01-20 00:00:00'").alias("new"), polarity(F.col("title")).alias("pol"))
    pairs = title_pairs(spark, sf_dir, TITLE_FLOOR)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    stored = rows.filter("not new").select(F.col("id").alias("other"), F.col("pol").alias("pol_other"))
    first = both.join(stored, "other").join(rows.filter("new").select("id", "pol"), "id").filter("not (pol != pol_other and pol != 'none' and pol_other != 'none')").groupBy("id").agg(F.min("other").alias("first_match"))
    return rows.filter("new").select("id").join(first, "id", "left")


def story_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, rule): y comes before x and tells the same story by its text (titles and contents alike) or its title (nearly
    equal, neither a placeholder nor the opposite)."""
    pairs = title_pairs(spark, sf_dir, 0.9)
    paired = pairs.select("a").union(pairs.select("b")).toDF("id").distinct()
    # bigrams are made once for each row and move as numbers
    told = stage(articles(spark, sf_dir).select("id", "title", polarity(F.col("title")).alias("pol"), coded(normalized(F.col("content"))).alias("g")).join(paired, "id", "left_semi"), "told")
    pairs = pairs.join(told.toDF("a", "title_a", "pol_a", "g_a"), "a").join(told.toDF("b", "title_b", "pol_b", "g_b"), "b")
    real = ~F.lower("title_a").isin(*PLACEHOLDERS) & ~F.lower("title_b").isin(*PLACEHOLDERS)
    rule = F.when(jaccard(F.col("g_a"), F.col("g_b")) >= TEXT_FLOOR, "same_text").when((F.col("sim") >= TITLE_FLOOR) & real & F.expr("not (pol_a != pol_b and pol_a != 'none' and pol_b != 'none')"), "same_title")
    return pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), rule.alias("rule")).filter("rule is not null")


def deduped_stories(rows: DataFrame, rivals: DataFrame) -> DataFrame:
    """rows (id, url_key), rivals (x, y, rule) -> (id, kept, rule, same_as): rows in the order of id; a kept earlier row with the
    same address or a kept rival drops one. rule and same_as tell why: the first rule of the chain, then the first row."""
    stages = Scratch(rows.sparkSession)
    links = stages(rivals, "rivals")
    kept = first_seen(rows, ["url_key"], links)
    owners = rows.join(kept.filter("kept"), "id", "left_semi").filter("url_key != ''").select("url_key", F.col("id").alias("y"))  # one of an address
    same_url = rows.select(F.col("id").alias("x"), "url_key").join(owners, "url_key").filter("x > y").select("x", "y", F.lit("same_url").alias("rule"))
    why = links.join(kept.filter("kept").select(F.col("id").alias("y")), "y", "left_semi").select("x", "y", "rule").union(same_url)
    order = F.when(F.col("rule") == "same_url", 0).when(F.col("rule") == "same_text", 1).otherwise(2)
    why = why.groupBy("x").agg(F.min_by(F.struct("rule", "y"), F.struct(order.alias("order"), "y")).alias("w"))
    out = stage(kept.join(why, kept.id == why.x, "left").select("id", "kept", F.when(~F.col("kept"), F.col("w.rule")).alias("rule"), F.when(~F.col("kept"), F.col("w.y")).alias("same_as")), "stories")
    stages.drop()
    return out


@query()
def dd_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-02, DD-04, DD-08: ordered deduplication by address, text and title, with the audit of every drop."""
    return deduped_stories(identity_keys(articles(spark, sf_dir)).select("id", "url_key"), story_rivals(spark, sf_dir))


@query(f"with {ARTICLES_SQL} select id, case when title = '' then 'no title' when country is null then 'no country' when length(content) < 20 then 'short' end as error, case when title = '' or country is null or length(content) < 20 then 'aside' else 'valid' end as part from articles")
def snk_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02: a batch is written, its bad rows aside with their errors; read back."""
    rows = articles(spark, sf_dir).select("id", "title", "country", "content")
    error = F.expr("case when title = '' then 'no title' when country is null then 'no country' when length(content) < 20 then 'short' end")
    return write_valid(rows, error, new_path(spark, "articles")).select("id", "error", "part")


@query("with c as (select user_id as step, count(*) filter (where event_type = 'error') as failures, max(value) as until from events group by 1) select c_custkey as step, case when until is null then 'inserted' when until < 90 and failures < 2 then 'updated' else 'refused' end as outcome from customer left join c on step = c_custkey")
def snk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SNK-06: claims are inserted, or take over a step whose lease is over and that has attempts left, else refused."""
    steps = VersionedTable(spark, new_path(spark, "steps"), "step")
    held = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step")).agg(F.count_if(F.col("event_type") == "error").cast("long").alias("attempt"), F.max("value").alias("until"))
    steps.write(held, 0)
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"), F.lit(1).cast("long").alias("attempt"), F.lit(90.0).alias("until"))
    return steps.upsert(claims, F.expr("held.until < 90 and held.attempt < 2"))[1]


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def snk_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: a version of a table without the listed keys."""
    kept = VersionedTable(spark, new_path(spark, "customers"), "c_custkey")
    kept.write(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 0)
    return kept.read(kept.delete(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))))


@query(f"with {KEYED_SQL} select country, count(*) as rows, count(distinct url_key) as addresses, count(distinct {NORM_SQL.format(x='title')}) as titles, count(distinct sha256(content)) as contents from keyed group by country")
def agg_story_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-01, AGG-05: how many different addresses, titles and texts each country has."""
    rows = identity_keys(articles(spark, sf_dir)).select("country", "url_key", normalized(F.col("title")).alias("title"), F.sha2("content", 256).alias("content"))
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("url_key").alias("addresses"), F.count_distinct("title").alias("titles"), F.count_distinct("content").alias("contents"))
