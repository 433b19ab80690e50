"""From documents to training shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import common, dart_minhash, decontam, langid, mixing, sharding

#: No stage's text matters to SQL alone: n-gram models, darts and bin packing can't be put in it.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and those in which no language has half of the text or more. Each row is judged
    by its text alone, so repeated rows and rows with a null doc_id stay or go alike."""
    return langid.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of equal or near texts, that with the smallest doc_id; of repeated rows one."""
    return dart_minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that passages of the benchmark cover by a twentieth or more; others stay as they are."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, those of small sources again in further epochs, as the weights ask."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, shard and slot: where each document goes."""
    return sharding.assign_shards(docs, keep=("text",)).select("doc_id", "text", "size", "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
