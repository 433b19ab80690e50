"""Exact duplicates: files with equal content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from .stats import same_size

ORDER = ("mtime", "path")


def with_hash(files: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    return files.withColumn("content_hash", content_hash(F.col(content), algorithm))


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """content_hash, size, n_files, wasted_space, is_cross_directory of each hash that two files or more have.
    Only counts are gathered, so a hash that a third of all files have is a row for each task."""
    groups = files.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(
        F.min_by("size", F.struct(*ORDER)).alias("size"), F.count(F.lit(1)).alias("n_files"),
        F.min("source_root").alias("a"), F.max("source_root").alias("b"),
    )
    return groups.where("n_files > 1").select(
        "content_hash", "size", "n_files", (F.col("size") * (F.col("n_files") - 1)).alias("wasted_space"),
        F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("is_cross_directory"),
    )


def duplicate_members(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The files of each group, a row each, with the group's columns; `rank` orders them by age."""
    groups = groups if groups is not None else duplicate_hashes(files)
    members = files.drop("wasted_space").join(groups.select("content_hash", "n_files", "wasted_space", "is_cross_directory"), "content_hash")
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("content_hash").orderBy(*ORDER)))


def exact_groups(files: DataFrame) -> DataFrame:
    """The groups with an array of their files, oldest first, most wasted space first. For reports: a group's files
    are gathered in one row."""
    kept = [c for c in files.columns if c not in ("content_hash", *ORDER)]
    members = files.join(duplicate_hashes(files).select("content_hash"), "content_hash", "left_semi")
    lists = members.groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct(*ORDER, *kept))).alias("files"))
    return duplicate_hashes(files).join(lists, "content_hash").orderBy(F.desc("wasted_space"), "content_hash")


def exact_summary(groups: DataFrame) -> DataFrame:
    """One row of totals; zeros where there are no groups."""
    zero = F.lit(0)
    wasted, cross = F.col("wasted_space"), F.col("is_cross_directory")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_files"), zero).alias("total_duplicate_files"), F.coalesce(F.sum(wasted), zero).alias("total_wasted_space"),
        F.coalesce(F.sum(F.when(cross, wasted)), zero).alias("cross_directory_wasted_space"), F.coalesce(F.sum(F.when(~cross, wasted)), zero).alias("intra_directory_wasted_space"),
    )


def find_duplicates(files: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """Groups of files with contents: only those that share their size with another are read and hashed."""
    return duplicate_hashes(with_hash(same_size(files), content, algorithm).drop(content))


def without_duplicates(files: DataFrame) -> DataFrame:
    """Files that are in no group; the one that would be kept goes too."""
    return files.join(duplicate_hashes(files).select("content_hash"), "content_hash", "left_anti")
