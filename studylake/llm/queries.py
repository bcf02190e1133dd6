"""The registered corpus queries: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, language_id, licence_scan, line_dedup, media, packing, period_runs, pii, quality_rules, simhash_dedup, token_store, toxicity
from .common import read_table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licence_scan.scan_documents(docs, licence_scan.fit_model(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_lines(line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), min_docs=10))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_scorer(docs, read_table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit_classifier(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.media_table(read_table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.digest_runs(period_runs.find_runs(period_runs.repeat_tails(read_table(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.digest_repairs(conversations.repair(conversations.damage(rows)), rows)


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_decontamination, op3_token_store, op4_line_dedup, op5_toxicity, op6_language_id, op7_pii, op8_packing, op9_media, op10_simhash, op11_quality_rules, op12_periodic_runs, op13_conversation_repair)}

ORACLE = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
""",
}
