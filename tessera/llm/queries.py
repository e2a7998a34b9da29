"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, jaccard, language, lines, matroska, mixcoder, packing, quality
from .common import stored, table

ORACLES: dict[str, str] = {
    "op9_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') x from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(x) >= 4 then list_transform(range(1, len(x) - 2), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3])
    when len(x) > 0 then [array_to_string(x, ' ')] else [] end)) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * m >= 85 * (x.n + y.n - m)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id from documents d left join n using (doc_id) join (select a doc_id, min(b) component_id from r group by a) c using (doc_id)""",
    "op10_chat_formatting": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '<turn>', '\o'), '</turn>', '\c') as body, replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\o'), '</turn>', '\c'), chr(10), '\n') as head from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(length(head) + length(body) + 15)::bigint formatted_chars
from e group by conv_id""",
}


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(table(spark, sf_dir, "documents"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_media(matroska.store_texts(table(spark, sf_dir, "documents")))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixcoder.through_files(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.text_digests(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(stored(chat.format_conversations(rows.unionByName(more)), "formatted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture, op2_matroska, op3_hnsw, op4_context_mixing_coder, op5_best_fit_packing, op6_quality_ftrl, op7_fuzzy_lines, op8_bpe_automaton, op9_ngram_jaccard,
        op10_chat_formatting,
    )
}
