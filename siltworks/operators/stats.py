"""Totals, counts by extension, size groups and scan filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScanOptions


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def extension_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"))


def extension_shares(files: DataFrame, decimals: int = 2) -> DataFrame:
    """Counts by extension with their share of all bytes in per cent; null where there are no bytes."""
    stats = extension_stats(files)
    total = F.sum("total_size").over(Window.partitionBy())
    return stats.withColumn("share", F.round(F.try_divide(F.col("total_size") * 100.0, total), decimals))


def top_extensions(files: DataFrame, n: int = 10, decimals: int = 2) -> DataFrame:
    return extension_shares(files, decimals).orderBy(F.desc("total_size"), "extension").limit(n)


def extension_list(text: str) -> tuple[str, ...]:
    """A comma-separated list as a scan takes it: lower case, with a full stop before; blanks stay."""
    return tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in text.split(",")) if text else ()


def scan_filter(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Sizes from min_size to max_size, and the extensions, if any are named."""
    if options.min_size is not None:
        files = files.where(F.col("size") >= options.min_size)
    if options.max_size is not None:
        files = files.where(F.col("size") <= options.max_size)
    if options.extensions:
        wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in options.extensions]
        files = files.where(F.col("extension").isin(*wanted))
    return files


def size_groups(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count(F.lit(1)).alias("n_files"))


def same_size(files: DataFrame) -> DataFrame:
    """Files that share their size with another. Sizes are counted with partial sums and joined, so a
    common size isn't gathered in one task."""
    shared = size_groups(files).where("n_files > 1").select("size")
    return files.join(shared, "size", "left_semi")
