"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, chat, dedup, language, media, neardup, packing, quality, records, token_count
from tabloom.llm.common import table

BYTE_VOCABULARY, WORD_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
POLICY = "v2"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.vocabulary_path(BYTE_VOCABULARY))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary_path(BYTE_VOCABULARY))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_and_read(table(spark, sf_dir, "documents"), bpe.vocabulary_path(WORD_VOCABULARY))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), POLICY)
    base = (~quality.passes("base")).alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "fail_mask")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()), bpe.vocabulary_path(PIECE_VOCABULARY))
    found = language.predict(docs, model, "doc_id")
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), bpe.vocabulary_path(WORD_VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_format, op2_suffix_dedup, op3_bpe_round_trip, op4_pack, op5_records, op6_media, op7_quality, op8_language, op9_near_duplicates, op10_token_counts]
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text,
    coalesce(length(role), -1) || ':' || coalesce(role, '') || coalesce(length(text), -1) || ':' || coalesce(text, '') AS body
  FROM conversations),
prefix AS (
  SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
    md5(string_agg(md5(body), '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
  FROM turns),
whole AS (SELECT min(conv_id) AS conv_id, n, h, count(*) AS n_copies FROM prefix WHERE k = n GROUP BY n, h),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.k < p.n AND p.k = w.n AND p.h = w.h))
SELECT t.conv_id, CAST(max(kept.n) AS BIGINT) AS n_turns, CAST(max(n_copies) AS BIGINT) AS n_copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
FROM turns t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id
"""

OP7_MEASURES_SQL = r"""
texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8),
eights AS (SELECT s.doc_id, i, w[i:i + 7] AS eight FROM starts s JOIN texts USING (doc_id)),
twice AS (SELECT doc_id, eight FROM eights GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM eights SEMI JOIN twice USING (doc_id, eight)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measures AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_echo_words
  FROM texts t JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
      + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (10 * coalesce(chars, 0) < 20 * n_words)::INT
      + 32 * (10 * coalesce(chars, 0) > 150 * n_words)::INT + 64 * (100 * n_echo_words > 20 * n_words)::INT AS BIGINT) AS fail_mask
  FROM measures)
"""
OP7_SQL = f"WITH {OP7_MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_mask = 0 AS kept, fail_mask FROM judged"


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op7_quality": OP7_SQL}
