"""Connected components of an edge table by alternating star contraction (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014); the edges stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of the edges (two columns of one type that can be ordered, no nulls) the
    smallest node of its component. In each round the larger neighbours of every node are linked to the smallest
    of its neighbourhood, then its smaller neighbours are; when that changes nothing, all edges lead to roots. A
    hub is only a key of an aggregate with partial sums and of a join that can be split."""
    links = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("r"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("r").alias("v")), F.struct(F.col("v").alias("u"), F.col("r").alias("v")))).alias("x"))
        links = materialise(small.select("x.u", "x.v").where("u != v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
