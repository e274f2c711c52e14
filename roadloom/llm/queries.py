"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.exact_dedup import exact_dedup
from roadloom.llm.filter_audit import filter_audit
from roadloom.llm.line_dedup import line_dedup
from roadloom.llm.packing import best_fit_packing
from roadloom.llm.quality_classifier import quality_scores
from roadloom.llm.quality_rules import quality_rules
from roadloom.llm.sentencepiece_fst import encode_documents
from roadloom.llm.sharding import shuffled_shards
from roadloom.llm.simhash import near_dedup
from roadloom.llm.spelling import spelling_variants
from roadloom.llm.tool_calls import link_tool_calls
from roadloom.llm.url_filter import UrlRule, rule_labelled, url_filter
from roadloom.llm.warc import archived
from roadloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

TOOL_SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}, "required": ["query", "limit"]},
    "fetch": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "mode": {"type": "string", "enum": ["text", "html"]}}, "required": ["query"]},
    "count": {"properties": {"query": {"type": "string"}, "limit": {"type": "number", "minimum": 10}}, "required": ["query", "mode"]},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that teach nothing: crc32 of doc_id as text is 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, URL_RULES, rule_labelled(pages, URL_RULES))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results in ``conversations``: each assistant turn is a call whose arguments hold its whole text and which
    depends on the calls two and, for a third of them, four turns before; the user turn after it is its result. The other
    turns (system, opening user turns) are results that no call asked for, named by role, conversation and turn. Arguments
    of one call in 17 lack their closing brace, so that they are no JSON; their text is whole too."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    named = lambda kind, turn: F.concat(kind, F.lit("_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    name = lambda turn: named(F.lit("call"), turn)
    text = F.coalesce("text", F.lit(""))
    code = F.crc32(text.cast("binary"))
    body = F.to_json(F.struct(text.alias("query"), (code % 50).alias("limit"), F.when(code % 4 == 1, F.element_at(F.array(F.lit("text"), F.lit("html"), F.lit("pdf")), (code % 3 + 1).cast("int"))).alias("mode")))
    before = F.array_compact(F.array(F.when(F.col("turn") >= 3, name(F.col("turn") - 2)), F.when((F.col("turn") >= 5) & (code % 3 == 0), name(F.col("turn") - 4))))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.element_at(F.array(*[F.lit(x) for x in ("search", "fetch", "count", "paint")]), (code % 4 + 1).cast("int")).alias("name"),
        F.when(code % 17 == 0, F.left(body, F.length(body) - 1)).otherwise(body).alias("arguments"),
        before.alias("depends_on"),
    )
    answer = F.when(F.expr("role = 'user' and turn >= 2"), name(F.col("turn") - 1)).otherwise(named(F.coalesce("role", F.lit("turn")), F.col("turn")))
    results = turns.where("role is distinct from 'assistant'").select("conv_id", answer.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(spark, sf_dir)
    return link_tool_calls(calls, results, TOOL_SCHEMAS, repeats=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffled_shards(table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = (
        op1_url_filter, op2_exact_dedup, op3_tool_calls, op4_quality_rules, op5_sentencepiece_fst, op6_simhash, op7_best_fit_packing,
        op8_sharding, op9_line_dedup, op10_quality_classifier, op11_warc, op12_spelling_variants, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


_OP2 = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

_OP4 = r"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), word as (
  select doc_id, unnest(words) as w, generate_subscripts(words, 1) as p from base
), gram as (
  select doc_id, p, w, lead(w, 1) over d as w1, lead(w, 2) over d as w2 from word window d as (partition by doc_id order by p)
), counted as (
  select doc_id, p, count(*) over (partition by doc_id, w, w1, w2) as n from gram where w2 is not null
), covered as (
  select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from counted where n > 1) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from base)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), stats as (
  select b.doc_id, b.text, len(words) as n_words, coalesce(length(array_to_string(words, '')), 0) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from base b left join covered c using (doc_id) left join lines l using (doc_id)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 10 > n_words or (length(text) - length(replace(text, '!', ''))) * 5 > n_words
    or n_dup_lines * 2 > length(text) - length(replace(text, chr(10), '')) + 1
    or length(regexp_replace(text, '\P{Lu}', '', 'g')) * 10 > word_chars * 3
    or word_chars < 2 * n_words or word_chars > 15 * n_words or n_repeat_words * 10 > n_words * 4) as kept
from judged
"""

_OP9 = r"""
with base as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as p from base),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line
), frequent as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
)
select d.doc_id, count(*) as n_lines, count(*) filter (f.k is not null and d.doc_id <> f.keeper) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (f.k is null or d.doc_id = f.keeper), '')) as kept_sha256
from keyed d left join frequent f on d.k = f.k group by d.doc_id
"""


_OP11 = r"""
with base as (
  select page_id, sha1(coalesce(html, '')) as hex, strlen(coalesce(html, '')) as payload_bytes, min(page_id) over (partition by coalesce(html, '')) as first from pages
), digits as (
  select page_id, payload_bytes, first, list_transform(range(8), lambda i: cast('0x' || substr(hex, cast(i * 5 + 1 as int), 5) as int)) as fives from base
)
select page_id, payload_bytes, list_reduce(list_transform(fives, lambda v: list_reduce(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) as payload_digest,
  case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to, true as intact
from digits
"""

_OP13 = r"""
with base as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as first,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), mark as (
  select doc_id, max(cast(quality is not distinct from 1 as int)) as good, max(cast(toxic is not distinct from 1 as int)) as toxic
  from labels where doc_id is not null group by doc_id
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, case when len(words) < 100 then 'A' else '' end
    || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
    || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when first < doc_id then 'E' else '' end as fails
  from base left join mark using (doc_id)
), letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
  select filter_order, s as step, substr(filter_order, s, 1) as f, substr(filter_order, 1, s - 1) as before from orders, (select unnest([1, 2, 3, 4, 5]) as s)
), counted as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all
), met as (
  select c.*, s.*, contains(fails, f) as fail, translate(fails, before, '') <> fails as gone from counted c, steps s
), found as (
  select part, filter_order, step, f, coalesce(sum(n) filter (not fail and not gone), 0) as kept, coalesce(sum(n) filter (fail and not gone), 0) as removed,
    coalesce(sum(n) filter (fail and gone), 0) as redundant, coalesce(sum(n) filter (fails = f), 0) as unique_fails,
    coalesce(sum(good) filter (fail and not gone), 0) as good_lost, coalesce(sum(toxic) filter (fail and not gone), 0) as toxic_lost
  from met group by all
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from found
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_quality_rules": _OP4, "op9_line_dedup": _OP9, "op11_warc": _OP11, "op13_filter_audit": _OP13}
