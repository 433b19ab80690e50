"""Sharding by vector bin packing: groups of equal texts go to shards so that bytes, tokens and rows are
balanced together; each goes where the dot product of its sizes and the shard's residual capacity is highest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: A group with this share of the bytes, tokens or rows is packed by itself; there are 3 / HEAVY at most.
HEAVY = 1 / 4096
#: Other groups are packed by the bucket of their hash.
BUCKETS = 4096
#: A group that fits in no shard is dealt out in pieces of about this share at most.
PIECE = 1 / 1024
#: Rows of a shard that are numbered in one task.
RUN_ROWS = 20_000


def pack(sizes: np.ndarray, n: int, groups: np.ndarray | None = None) -> np.ndarray:
    """Bin of each unit. sizes: a row per unit with its share of bytes, tokens and rows. groups: the number of
    each unit's group from 0, by default each is its own. Groups of several units go first, the largest before
    the others, each as a whole to the bin where its dot product with the residual capacity is highest, of
    those that it fits in. Then all other units and those of groups that fit in no bin, likewise, but to the
    best of all bins where none has room; ties go to the first bin. At the end, units that aren't parts of a
    group placed as a whole move between the fullest and the emptiest bin while that evens the bytes."""
    bins = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins
    groups = np.arange(len(sizes)) if groups is None else groups
    left = np.full((n, sizes.shape[1]), 1 / n)
    whole = np.zeros((groups.max() + 1, sizes.shape[1]))
    np.add.at(whole, groups, sizes)
    members = np.split(np.argsort(groups, kind="stable"), np.cumsum(np.bincount(groups))[:-1])
    loose = np.ones(len(sizes), bool)
    for g in np.argsort(-whole.max(axis=1), kind="stable"):
        fits = (left >= whole[g]).all(axis=1)
        if len(members[g]) > 1 and fits.any():
            bins[members[g]] = k = np.argmax(np.where(fits, left @ whole[g], -np.inf))
            left[k] -= whole[g]
            loose[members[g]] = False
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        if loose[i]:
            score, fits = left @ sizes[i], (left >= sizes[i]).all(axis=1)
            bins[i] = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
            left[bins[i]] -= sizes[i]
    for _ in range(4 * n):
        full, empty = np.argmin(left[:, 0]), np.argmax(left[:, 0])
        gap = (left[empty, 0] - left[full, 0]) / 2
        mine = np.flatnonzero((bins == full) & loose & (sizes[:, 0] <= gap) & (sizes[:, 0] > 0))
        if not len(mine):
            break
        i = mine[np.argmax(sizes[mine, 0])]
        bins[i] = empty
        left[full] += sizes[i]
        left[empty] -= sizes[i]
    return bins


def measures(text):
    """UTF-8 bytes plus 1, and pieces between blanks; null is as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text).cast("long")
    return size + 1, size - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def assign_shards(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text), and the
    columns in keep (none of them may have such a name). Law `bytes`: the shards' sizes are near equal. Equal
    texts share a shard unless no shard has room for them at their turn: then the rows are cut into pieces by
    the hash of doc_id. Null texts are as empty ones. Repeated rows are as other equal texts. slot: gapless from 0
    in each shard, by hash run and doc_id; grown_shard: null, a law `bytes` doesn't use it.

    The driver packs 3 / HEAVY + BUCKETS groups and 3 / PIECE pieces at most. No text is shuffled unless kept."""
    h, tokens, piece, unit, run = fresh(docs, "text_hash", "n_tokens", "piece", "unit", "run")
    size, words = measures(F.col("text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), *keep, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(h), words.alias(tokens)
    )
    sizes = rows.select("doc_id", "size", h, tokens)
    if not keep:
        rows = materialise(rows, "shard-rows")
        sizes = rows.select("doc_id", "size", h, tokens)
    sums = (F.sum("size").alias("b"), F.sum(tokens).alias("t"), F.count(F.lit(1)).alias("r"))
    groups = materialise(sizes.groupBy(h).agg(*sums), "shard-groups")
    total = groups.agg(*(F.sum(c).alias(c) for c in "btr")).first()
    b, t, r = (float(x or 1) for x in total)
    n_rows = int(total.r or 0)
    share = F.greatest(F.col("b") / b, F.col("t") / t, F.col("r") / r)
    heavy = groups.where(share >= HEAVY).select(h, F.ceil(share / PIECE).alias(piece))

    def with_unit(df):
        hot = df.join(F.broadcast(heavy), h, "left")
        part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.col(piece))
        return hot.withColumn(unit, F.when(F.col(piece).isNull(), F.pmod(F.col(h), F.lit(BUCKETS))).otherwise(F.xxhash64(h, part))).withColumn(
            piece, F.col(piece).isNotNull()
        )

    of = F.coalesce(F.min(F.when(F.col(piece), F.col(h))), F.col(unit)).alias("g")
    packed = with_unit(sizes).groupBy(piece, unit).agg(*sums, of).orderBy(piece, unit).toPandas()
    bins = pack(packed[["b", "t", "r"]].to_numpy(float) / [b, t, r], shards, packed.groupby([piece, "g"]).ngroup().to_numpy())
    packed["shard"] = bins.astype("int32")
    spark = docs.sparkSession
    placed = spark.createDataFrame(packed[[piece, unit, "shard"]], f"{piece} boolean, {unit} long, shard int")
    runs = max(64, -(-n_rows // (shards * RUN_ROWS)))
    out = with_unit(rows).join(F.broadcast(placed), [piece, unit]).withColumn(run, F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(runs)))
    counts = with_unit(sizes).join(F.broadcast(placed), [piece, unit]).groupBy("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(runs)).alias(run)).agg(F.count(F.lit(1)).alias("r"))
    before = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", run, F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r"))
    inside = Window.partitionBy("shard", run).orderBy("doc_id", "text_crc32")
    numbered = out.withColumn(tokens, F.row_number().over(inside) - 1).join(starts, ["shard", run])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("r") + F.col(tokens)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes the texts as Parquet below path, a folder shard=N per shard, rows with their slot."""
    out = assign_shards(docs, shards, keep=("text",))
    out.select("doc_id", "text", "slot", "shard").write.partitionBy("shard").parquet(path)
