"""The numbered queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .additive_quality import score_documents
from .block_labeller import extract_pages
from .chunk_recipes import dedupe_exact
from .cutting_stock import pack
from .language_model import predicted_languages
from .minhash_join import near_duplicates
from .periodic_runs import run_report, with_repeated_tails
from .piece_codec import encode_documents
from .robust_outliers import judge
from .shared import documents
from .snapshot_collapse import maximal_conversations
from .suffix_dedup import removal_report
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, code_report
from .warc_members import archive_round_trip

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), str(public_tokenizers.path(WORD_TOKENIZER)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_exact(documents(spark, sf_dir))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), str(public_tokenizers.path(PIECE_MODEL)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(with_repeated_tails(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_packing, op3_near_dedup, op4_warc, op5_html_text, op6_exact_dedup, op7_chat_collapse, op8_suffix_dedup, op9_quality_classifier, op10_sentencepiece, op11_vector_codes, op12_language_id, op13_periodic_runs)
}

_OP3 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), sizes as (select doc_id, len(s) as n_shingles from sets
), posts as (select doc_id, unnest(s) as x from sets
), met as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from posts a join posts b on a.x = b.x and a.doc_id < b.doc_id group by all
), links as (
  select a, b from met join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b where 100 * common >= 75 * (sa.n_shingles + sb.n_shingles - common)
), ways as (select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as root from sizes
  union
  select ways.b, reach.root from reach join ways on ways.a = reach.doc_id and reach.root < ways.b
), lowest as (select doc_id, min(root) as component_id from reach group by doc_id)
select doc_id, cast(n_shingles as bigint) as n_shingles, component_id, doc_id = component_id as kept from sizes join lowest using (doc_id)
"""

_OP4 = """
with payloads as (
  select page_id, coalesce(html, '') as html from pages
), firsts as (
  select html, min(page_id) as first_id from payloads group by html
), hashed as (
  select page_id, first_id, strlen(html) as payload_bytes, sha1(html) as h from payloads join firsts using (html)
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from hashed
"""

_OP6 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

_OP7 = """
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
), gathered as (
  select conv_id, list({'role': role, 'text': text} order by turn, role, text) as t from turns group by conv_id
), firsts as (
  select t, min(conv_id) as conv_id from gathered group by t
), prefixes as (
  select distinct t[1:i] as p from (select t, unnest(range(1, len(t))) as i from gathered)
)
select conv_id, len(t) as n_turns, array_to_string(list_transform(t, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)), '') as rendered
from firsts where t not in (select p from prefixes)
"""



def _op11() -> str:
    """Lloyd's rounds unrolled. parts (vec_id, part, x) holds integers, bookN (part, entry, c) the codebooks after N rounds."""
    ctes = [
        f"""kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"""parts as (
  select row, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as x
  from (select *, row_number() over () as row, unnest(range(0, {PARTS})) as part from kept)
)""",
        f"book0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from parts where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES}))",
    ]
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))"
    for r in range(ROUNDS + 1):
        ctes.append(f"""near{r} as (
  select row, vec_id, label, part, x, arg_min(entry, (d, entry)) as entry, min(d) as d
  from (select row, vec_id, label, p.part, x, entry, cast({far} as bigint) as d from parts p join book{r} b on p.part = b.part) group by all
)""".replace("group by all", "group by row, vec_id, label, part, x"))
        if r < ROUNDS:
            ctes.append(f"""book{r + 1} as (
  select b.part, b.entry, coalesce(m.c, b.c) as c from book{r} b left join (
    select part, entry, list((s - ((s % n + n) % n)) // n order by k) as c
    from (select part, entry, k, cast(sum(x[k]) as bigint) as s, count(*) as n from (select part, entry, x, unnest(range(1, len(x) + 1)) as k from near{r}) group by part, entry, k)
    group by part, entry
  ) m on m.part = b.part and m.entry = b.entry
)""")
    return f"""with {", ".join(ctes)}, whole as (
  select row, vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by row, vec_id, label
), digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from whole, digest"""


#: The others learn a model, call a library or compare every 400 bytes; tests hold them against brute force.
ORACLE_SQL = {"op3_near_dedup": _OP3, "op4_warc": _OP4, "op6_exact_dedup": _OP6, "op7_chat_collapse": _OP7, "op11_vector_codes": _op11()}
