"""From raw documents to a sharded training mix; every stage is one operator of verdictflow.llm.

Each stage takes (spark, docs, sf_dir). Its result is written as Parquet to the shared folder and read
again as the next stage's docs, so a lost executor costs no more than one stage. The result of the stage before
is deleted once the next is written; the last one stays for the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm import decontamination, mixing, quality, sharding, simhash
from verdictflow.llm._shared import delete_path, scratch_path, table

#: Jaccard similarity over five-word shingles.
NEAR_SHARE = 0.8
SHARDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.near_dedup(docs, NEAR_SHARE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated as the mix takes them."""
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Classifier, fingerprints and sampling are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
