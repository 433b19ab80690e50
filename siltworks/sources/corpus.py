"""Tables seen as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_as_files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """documents as file rows: the source is the root, the language the extension; times and depths come from the id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    id_ = F.col("doc_id")
    rows = d.select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), id_.cast("string"), F.lit("."), "lang").alias("path"),
        F.concat(id_.cast("string"), F.lit("."), "lang").alias("name"), F.octet_length("text").cast("bigint").alias("size"), F.concat(F.lit("."), "lang").alias("extension"),
        ((id_ * 7919) % 1000003).alias("mtime"), (id_ % 4).cast("int").alias("depth"), F.concat(F.lit("/"), "source").alias("source_root"), "doc_id", "text",
    )
    return rows if content else rows.drop("text")


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(spark, sf_dir, True).withColumn("content_hash", F.sha2("text", 256)).drop("text")


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("size"))
