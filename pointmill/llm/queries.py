"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pointmill.llm import op1_quality, op2_toxicity, op3_bpe, op4_decontaminate, op5_secrets, op6_substrings, op7_lines, op8_simhash, op9_sharding, op10_quality, op11_merkle, op12_alignment, op13_bytes
from pointmill.llm.common import table, vocabulary


def op1_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_substrings.digest(table(spark, sf_dir, "documents"))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets.scan(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_sharding.digest(op9_sharding.shard(table(spark, sf_dir, "documents"), 40))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality.assess(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_decontaminate_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_lines.digest(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_simhash.digest(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_merkle.digest(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_alignment.score(table(spark, sf_dir, "documents"), op12_alignment.vocabularies())


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_bytes.encode(table(spark, sf_dir, "documents"), op13_bytes.vocabulary(), digest=True)


QUERIES = {f.__name__: f for f in (op1_quality_score, op2_toxicity_score, op3_bpe_encode, op4_decontaminate_leaks, op5_secret_scan, op6_substring_dedup, op7_line_dedup, op8_simhash_dedup, op9_shard, op10_quality_rules, op11_merkle_manifest, op12_token_alignment, op13_byte_bpe)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op7_line_dedup": op7_lines.SQL, "op10_quality_rules": op10_quality.SQL, "op11_merkle_manifest": op11_merkle.SQL}
