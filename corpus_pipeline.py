"""The training-data pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsbook.llm import decontaminate, packing, quality, simhash, substrings
from opsbook.llm.shared import mark, remove, shared_dir, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a smaller doc_id has; n_chars follows, and texts left blank go."""
    left = substrings.remove_repeats(docs)
    changed = F.col("__removed.spans") > 0
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.where(~changed | F.col("text").rlike(r"\S")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_neardup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL can express none of the stages; tests hold them against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage has read and what it wrote on the way go once its result is written; the last result stays.
    """
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        sweep(spark, since)
        if k:
            remove(spark, f"{at}/{k - 1}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
