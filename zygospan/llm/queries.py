"""Thin registered queries of the operators and their SQL, where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospan.llm import alignment, chat, exact_dedup, language, lexical, mixing, packing, quality, rules, simhash, suffix_dedup, topk, toxicity
from zygospan.llm.common import held_out, training_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op6_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out("doc_id", 4, 2)))
    return language.identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "margin")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, training_rows(table(spark, sf_dir, "labels"), "quality", 5, 0, quality.SAMPLE))
    rows = quality.score(docs, model)
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_rows(table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.SAMPLE))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(100)) == 0), k=10)


ORACLES["op9_exact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from pairs)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 10
"""


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_conversations(chat.from_turns(rows.unionByName(own))))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLES["op11_lexical_search"] = r"""
with words as (
  select row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as row_id, doc_id, text from documents)
), wanted as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by item_id, term
), lengths as (select row_id, count(*) as n from words group by row_id),
totals as (select count(*) as big_n, sum(n)::bigint as big_l from lengths),
tf as (select row_id, any_value(doc_id) as doc_id, term, count(*) as tf from words where term in (select term from wanted) group by row_id, term),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::double)) as bigint) as w from tf, totals group by term
), scored as (
  select item_id, row_id, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint as score
  from tf join lengths using (row_id) join weights using (term) join wanted using (term), totals group by item_id, row_id
), ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked where r <= 20
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op13_quality_rules"] = r"""
with docs as (select row_number() over () as row_id, doc_id, lang, source, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
windows as (select row_id, i, array_to_string(w[i : i + 4], ' ') as win from (select row_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) > 5)),
hits as (select row_id, i from windows qualify count(*) over (partition by row_id, win) > 1),
covered as (select row_id, count(distinct p) as n_repeat_words from (select row_id, unnest(range(i, i + 5)) as p from hits) group by row_id),
lines as (
  select row_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select row_id, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by row_id
), base as (
  select row_id, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_lines, 0) as n_lines,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from words left join covered using (row_id) left join lines using (row_id)
), failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base),
long as (
  select row_id, lang, source, base_failed, unnest([
    {m: 'word_chars', v: 1000 * word_chars // greatest(n_words, 1), slack: 1500}, {m: 'symbols', v: 1000 * n_symbols // greatest(n_words, 1), slack: 150},
    {m: 'dup_lines', v: 1000 * n_dup_lines // greatest(n_lines, 1), slack: 400}, {m: 'repeat_words', v: 1000 * n_repeat_words // greatest(n_words, 1), slack: 200}
  ]) as x from failed
), bucketed as (
  select row_id, lang, source, base_failed, x.m as m, x.v as v, x.slack as slack,
         x.v - x.v % cast(pow(2, greatest(length(bin(x.v)) - 6, 0)) as bigint) as b from long
), ranked as (
  select 0 as level, lang, source, m, b, row_number() over (partition by lang, source, m order by b) - 1 as r, count(*) over (partition by lang, source, m) as n from bucketed where not base_failed
  union all
  select 1, lang, null, m, b, row_number() over (partition by lang, m order by b) - 1, count(*) over (partition by lang, m) from bucketed where not base_failed
  union all
  select 2, null, null, m, b, row_number() over (partition by m order by b) - 1, count(*) over (partition by m) from bucketed where not base_failed
), q as (
  select level, lang, source, m, any_value(n) as n, max(b) filter (r = (n - 1) // 4) as q1, max(b) filter (r = 2 * (n - 1) // 4) as q2, max(b) filter (r = 3 * (n - 1) // 4) as q3
  from ranked group by level, lang, source, m
), chosen as (
  select g.lang, g.source, g.m, case when g.n >= 50 then g.q1 when l.n >= 50 then l.q1 else a.q1 end as q1,
         case when g.n >= 50 then g.q2 when l.n >= 50 then l.q2 else a.q2 end as q2, case when g.n >= 50 then g.q3 when l.n >= 50 then l.q3 else a.q3 end as q3
  from q g join q l on l.level = 1 and l.m = g.m and l.lang is not distinct from g.lang join q a on a.level = 2 and a.m = g.m where g.level = 0
), verdict as (
  select row_id, bool_and(coalesce(v between least(q1 - 3 * (q3 - q1), q2 - slack) and greatest(q3 + 3 * (q3 - q1), q2 + slack), false)) as good
  from bucketed b left join chosen c on b.m = c.m and b.lang is not distinct from c.lang and b.source is not distinct from c.source group by row_id
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and good as kept
from failed join verdict using (row_id)
"""
