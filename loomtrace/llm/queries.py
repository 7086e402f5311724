"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import masked_lm

    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, *masked_lm.fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomtrace.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.sampled(docs, labels, ~toxicity.held_out(F.col("id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import quality

    return quality.rules(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomtrace.llm import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import simhash

    return simhash.components(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import pii

    return pii.spans(table(spark, sf_dir, "documents"))


def op9_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import avi

    return avi.digests(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import byte_bpe

    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import piece_bpe

    return piece_bpe.digests(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtrace.llm import resampling

    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force in tests/llm."""
    from loomtrace.llm import filter_audit, resampling, secrets

    return {"op6_secrets": secrets.oracle_sql(), "op11_filter_audit": filter_audit.oracle_sql(), "op13_resampling": resampling.oracle_sql()}
