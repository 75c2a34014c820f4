"""A corpus on its way to training sequences: five stages, each a table that the next one reads.

Quality rules, toxicity, near duplicates and secrets keep the columns of ``documents``; packing, the
last, returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepforge.llm import near_duplicates, packing, quality, secrets, toxicity
from prepforge.llm.queries import WORD_BPE, tokenizer_path
from prepforge.llm.storage import small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by frequent lines go."""
    small_batches(spark)
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled training rows among the documents that are left; those scoring 0.5 or more go."""
    small_batches(spark)
    model = toxicity.ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_civil(docs, model)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    small_batches(spark)
    return near_duplicates.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of even cost."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicate_removal), ("secrets", secret_redaction), ("packing", sequence_packing)]
ORACLE_SQL = None  # trained models and hashed signatures are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
