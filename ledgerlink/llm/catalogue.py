"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.llm import decontaminate, jaccard, licenses, mixing, oracles, quality, sharding, suffixes, tokens, toxicity, warc
from ledgerlink.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.materialise(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_source_mixing, op3_virtual_slot_sharding, op4_ngram_jaccard_join, op5_quality_rules, op6_token_shards, op7_suffix_array_dedup, op8_warc_round_trip, op9_benchmark_decontamination, op10_toxicity)}


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id) AS first_id,
         row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS rn
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND rn > 1 THEN first_id END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": oracles.licence_sql(), "op4_ngram_jaccard_join": oracles.JACCARD, "op5_quality_rules": oracles.quality_sql(), "op8_warc_round_trip": OP8_SQL}
