"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``: quality rules and toxicity drop the documents they reject, near-dedup (operator 7's trie
join over five-word shingles, completed and verified at a Jaccard of 0.8) keeps the document of each group
with the smallest id, PII replaces personal data in the texts by its kind
(``n_chars`` follows the new text, if there is such a column), and packing gives the pieces of the token
sequences.

Null texts count as empty: quality rules reject them, so no later stage has one. Equal texts get equal
verdicts, and of rows equal in id and text one stays; of a group of near copies the smallest id stays, and
rows without an id stay. Very long texts cost time and memory in proportion to their length. An empty table
passes through every stage. Further columns of any name are kept, and no stage computes with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import neardup, packing, pii, quality, toxicity
from loomtrace.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(*toxicity.sampled(docs, labels, ~toxicity.held_out(F.col("id"))))
    return toxicity.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic), ("near-dedup", near_dedup), ("PII", personal_data), ("packing", pack)]
#: EM, a trained classifier and a tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
