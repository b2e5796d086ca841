"""The ten operators applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lm_score, packing, quality, secret_scan, simhash, suffix_dedup, token_counts, token_ids
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = token_ids.write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "word", end_id=2)
    return token_ids.read_token_files(spark, uri)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.told_with_ablations(quality.stored_ledger(documents(spark, sf_dir)), quality.POLICIES["default", 1])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy", "sole_rule", "n_back_without")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), "byte_level", end_id=0, capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_ids, op2_suffix_dedup, op3_decontamination, op4_quality_rules, op5_chat_format, op6_simhash, op7_token_counts, op8_secret_scan, op9_lm_score, op10_best_fit_packing)
    return {f.__name__: f for f in every}


QUALITY_ORACLE = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
often AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN often USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(w.w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$'))) AS n_upper,
             len(list_filter(w.w, lambda x: regexp_matches(x, '[^\\x00-\\x7F]') OR regexp_matches(x, '^[.,;:!?"''()]*[A-Za-z]+[.,;:!?"''()]*$'))) AS n_letters
      FROM w LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 0 AND 10 * n_symbols > n_words)::BIGINT
             + 8 * (10 * n_dup_lines > 6 * n_lines)::BIGINT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words))::BIGINT
             + 32 * (n_words > 0 AND 10 * n_upper > 4 * n_words)::BIGINT + 64 * (n_words > 0 AND 10 * n_letters < 6 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, 'default/1' AS policy, CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeats' WHEN 4 THEN 'symbols' WHEN 8 THEN 'dup_lines'
       WHEN 16 THEN 'word_length' WHEN 32 THEN 'shouting' WHEN 64 THEN 'no_letters' END AS sole_rule, CASE WHEN failed IN (1, 2, 4, 8, 16, 32, 64) THEN count(*) OVER (PARTITION BY failed) END AS n_back_without FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op4_quality_rules": QUALITY_ORACLE, "op9_lm_score": lm_score.ORACLE}
