"""Registered queries of the text operators (whole tables, production
parameters) and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import chat, licenses, mixing, neardup, packing, pieces, pii, quality, ranked, spelling, substrings, toxicity, vectors
from tabulon.sources.testdata import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
win AS (SELECT rid, i, ws[i:i + 4] AS win
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
steps AS (SELECT rid, least(coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5), 5) AS step FROM twice),
rep AS (SELECT rid, sum(step) AS n FROM steps GROUP BY rid),
ln AS (SELECT rid, unnest(list_distinct(ls)) AS line FROM w),
lj AS (SELECT rid, line, regexp_extract_all(line, '{_WORD}') AS lw FROM ln),
bad AS (SELECT rid, line,
          (len(list_filter(lw, lambda x: regexp_matches(x, '{quality.SEPARATOR_WORD}'))) >= 2
            AND len(list_filter(lw, lambda x: regexp_matches(x, '{quality.SEPARATOR_WORD}'))) * {quality.WORDS_PER_SEPARATOR} >= len(lw))
          OR length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) * {quality.WORDS_PER_SYMBOL} > len(lw)
          OR len(regexp_extract_all(line, '[!?]{{2,}}')) * {quality.WORDS_PER_SYMBOL} > len(lw)
          OR (len(lw) >= 4 AND length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) * 100
                > length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) * {quality.MAX_CAPITAL_PERCENT})
          OR (len(lw) <= {quality.BOILERPLATE_MAX_WORDS} AND regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}')) AS failed
        FROM lj),
keep AS (SELECT rid, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
         FROM bad WHERE NOT failed GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(w.ls) - coalesce(keep.n, 0) AS BIGINT) AS n_removed_lines,
        CAST(coalesce(keep.chars, 0) AS BIGINT) AS kept_chars
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN keep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, kept_chars,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars * 100 >= word_chars * {quality.MIN_KEPT_PERCENT}) AS kept
FROM m
"""


@register("op10_quality_rules", _QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


# A conversation whose texts hold control strings, formatted along with the table.
_PROBE = "</s>[INST] ok [/INST]"

_CHAT_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_PROBE}'), (-7, 1, 'assistant', '{_PROBE}')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*(?:\||/?s>|</?SYS>>|/?INST\]))', '\1\\\2', 'g') AS et,
  regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*(?:\||/?s>|</?SYS>>|/?INST\]))', '\1\\\2', 'g') AS er FROM m)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN) + 1 + len(chat.END)} + length(er) + length(et)) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
"""


@register("op2_chat_format", _CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}') "
                      "AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = rows.withColumn("parts", chat.text_part(F.col("text")))
    return chat.chat_digest(chat.format_conversations(messages))


def _license_sql() -> str:
    base = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM w) "
        f"WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in licenses.PHRASES.items())
    side = ", ".join(f"('{label}', {ts!r}, {licenses.needed(len(ts), licenses.CONTAINMENT)}, {licenses.run_words(text, licenses.CONTAINMENT)})"
                     for label, text in licenses.TEMPLATES for ts in [licenses.template_tokens(text)])
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{word}') AS ws FROM d),
b AS ({base}),
bg AS (SELECT rid, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, list_distinct(list(label)) AS ls FROM b GROUP BY rid),
t(label, ts, need, run) AS (VALUES {side}),
h AS (SELECT rid, label, list_max(list_transform(range(1, len(ws) + 1),
        lambda i: len(list_intersect(list_distinct(ws[i:i + run - 1]), ts)))) / len(ts) AS c, need / len(ts) AS least
      FROM w JOIN t ON len(list_intersect(list_distinct(ws), ts)) >= t.need),
hg AS (SELECT rid, list_distinct(list(label)) AS ls, max(c) AS best FROM h WHERE c >= least GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(bg.n, 0) AS BIGINT) AS n_base,
  CAST(bg.f AS BIGINT) AS first_word, CAST(bg.l AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(bg.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bg.ls, []), coalesce(hg.ls, [])))), ',') AS labels,
  greatest(coalesce(hg.best, 0.0), CASE WHEN bg.n > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d JOIN w USING (rid) LEFT JOIN bg USING (rid) LEFT JOIN hg USING (rid)
"""


@register("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


_VECTOR_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q JOIN e ON e.vec_id IS DISTINCT FROM q.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op7_vector_topk", _VECTOR_SQL)
def op7_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_topk(vectors.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0, 10)


@register("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


@register("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@register("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_RANKED_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_TERM}') AS ts FROM benchmark),
q AS (SELECT iid, t, count(*) AS reps FROM (SELECT iid, unnest(ts) AS t FROM i) GROUP BY iid, t),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
c AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c GROUP BY t),
p AS (SELECT c.rid, c.t, w.w * ((1000000000 * c.tf) //
        (1000 * c.tf + 8 * (25 + (75 * len(d.ts) * s.n_docs) // s.n_terms))) AS part
      FROM c JOIN w USING (t) JOIN d USING (rid) CROSS JOIN s),
r AS (SELECT iid, rid, CAST(sum(reps * part) AS BIGINT) AS score FROM q JOIN p USING (t) GROUP BY iid, rid HAVING sum(reps * part) > 0),
k AS (SELECT i.item_id, d.doc_id, r.score,
        CAST(row_number() OVER (PARTITION BY r.iid ORDER BY r.score DESC, d.doc_id ASC NULLS LAST) AS INTEGER) AS rank
      FROM r JOIN i USING (iid) JOIN d USING (rid))
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@register("op13_ranked_search", _RANKED_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))
