"""Size bands: files sorted by size, in greedy runs that begin at their smallest size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_anchors(files: DataFrame, tolerance: float) -> list[int]:
    """The smallest size of each band. Each anchor is found from the last by one pass of a fold over the distinct sizes; there are
    as many as powers of 1 + tolerance in the largest size, so the list stays short. Where there are too many distinct
    sizes for one array, the next anchor is asked for instead, one after the other."""
    sizes = files.select("size").distinct()
    if sizes.count() <= 1_000_000:
        row = sizes.agg(F.array_sort(F.collect_list("size")).alias("s")).select(
            F.aggregate("s", F.array().cast("array<bigint>"), lambda a, s: F.when((F.size(a) == 0) | (s.cast("double") > F.element_at(a, -1) * F.lit(1 + tolerance)), F.concat(a, F.array(s))).otherwise(a)).alias("a")
        )
        found = row.first()
        return list(found.a or []) if found else []
    anchors, last = [], sizes.agg(F.min("size")).first()[0]
    while last is not None:
        anchors.append(last)
        last = sizes.where(F.col("size").cast("double") > F.lit(float(last)) * F.lit(1 + tolerance)).agg(F.min("size")).first()[0]
    return anchors


def band_of(size: Column, anchors: list[int]) -> Column:
    """The largest anchor that isn't above the size."""
    known = F.array(*(F.lit(int(a)).cast("bigint") for a in anchors)) if anchors else F.array().cast("array<bigint>")
    return F.array_max(F.filter(known, lambda a: a <= size))


def with_bands(files: DataFrame, tolerance: float) -> DataFrame:
    return files.withColumn("band", band_of(F.col("size"), band_anchors(files, tolerance)))
