"""Near duplicates: blocked pairs, pruned without loss, then similarity, threshold and groups."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEDIA_TOLERANCE, TEXT_TOLERANCE, NearOptions
from ..functions import bits, color, sketch, text
from ..tables import materialise
from .banding import with_bands
from .components import components

EPS = 1e-9


#: Rows of a block; a task compares the square of it, or more.
DEALT = 4096


def dealt_pairs(x: DataFrame, y: DataFrame, keys: list[str], within: bool, size: int | None = None) -> DataFrame:
    """Rows of x beside those of y (their columns named x_ and y_) with equal keys and different paths, in blocks of size by size rows
    (DEALT), so that a hot key is many tasks: a key's rows are dealt out by the hash of their path. within: y is x, and each
    pair is made once, in no certain order."""
    known = F.lit(True)
    for c in (*keys, "path"):
        known &= F.col(c).isNotNull()
    x, y = x.where(known), y.where(known)

    def cut(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (size or DEALT)).cast("int").alias(name))

    parts = cut(x, "i_")
    parts = parts.withColumn("j_", F.col("i_")) if within else parts.join(cut(y, "j_"), keys)

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        i, j = (F.pmod(F.xxhash64("path"), F.col(c)).cast("int") for c in ("i_", "j_"))
        first, last = (F.lit(0), i) if within and side == "y" else (i if within else F.lit(0), F.col("j_" if side == "x" else "i_") - 1)
        at = (i, F.explode(F.sequence(first, last))) if side == "x" else (F.explode(F.sequence(first, last)), j)
        rows = rows.join(parts, keys).select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns), at[0].alias(f"{side}i"), at[1].alias(f"{side}j"))
        count = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(count, *(f"{side}_{k}" for k in keys), f"{side}i", f"{side}j")  # a number, as small rows make much work

    on = (F.col("xi") == F.col("yi")) & (F.col("xj") == F.col("yj"))
    for k in keys:
        on &= F.col(f"x_{k}") == F.col(f"y_{k}")
    apart = (F.col("xi") < F.col("xj")) | (F.col("x_path") < F.col("y_path")) if within else F.col("x_path") != F.col("y_path")
    return dealt(x, "x").join(dealt(y, "y"), on & apart)


#: Of a pair, the smaller path and the larger.
ENDS = (F.least, F.greatest)


def ends() -> list:
    return [f("x_path", "y_path").alias(f"file{k}") for k, f in enumerate(ENDS, 1)]


def once(value: Column) -> Column:
    """value, a double. What is added is 0, but Spark takes it as not deterministic and so doesn't work it out in a join's condition
    and once more after it."""
    return value + F.spark_partition_id() * 0.0


def scored(pairs: DataFrame, similar: Column, threshold: float) -> DataFrame:
    """file1, file2, similarity of the pairs that reach the threshold."""
    return pairs.select(*ends(), once(similar).alias("similarity")).where(F.col("similarity") >= threshold)


def blocked_pairs(files: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairs of files with equal keys, the smaller path first."""
    rows = materialise(files.select(*keys, "path", *columns), "near-rows")
    both = dealt_pairs(rows, rows, keys, True)
    ordered = F.col("x_path") < F.col("y_path")
    sides = {1: ("x", "y"), 2: ("y", "x")}
    return both.select(*ends(), *(F.when(ordered, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{c}{i}") for c in columns for i, (a, b) in sides.items()))


def pair_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """How many pairs each block has, from counts alone."""
    n = F.count(F.lit(1))
    return files.groupBy(*keys).agg(n.alias("n_files"), (n * (n - 1) / 2).cast("long").alias("n_pairs"))


#: Rows of a block of sketches, and bytes of them.
SKETCHED, SKETCH_BYTES = 16384, 1 << 24
#: Numbers of 64 bits that a sketch of a file's words has, up to bands of so many bytes; in larger bands, as many times more, a power of two, at most. A
#: sketch tells unlike files apart as long as it has about as many bits as each has words.
LONGS, BYTES, TIMES = 8, 2400, 128
#: Texts of a block in which pairs are compared by their words, and bytes of them; pairs that are worked on at a time, and bytes of texts that these hold.
COMPARED, COMPARED_BYTES, AT_ONCE, HELD = 128, 1 << 23, 4096, 1 << 26
CELL = ["band", "extension", "i", "j"]


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Of batches sorted by CELL, the rows of each cell, in one piece or more."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in CELL), strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                yield keys[start], batch.slice(start, k - start)
                start = k


def into_cells(rows: DataFrame, *then: str) -> DataFrame:
    """rows in tasks that have whole cells. A number of tasks is given, as comparing is more work than bytes tell."""
    count = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *CELL).sortWithinPartitions(*CELL, *then)


def sketched(texts: DataFrame) -> DataFrame:
    """id, path, band, extension, longs, n, s: how many words each text has, and numbers of 64 bits, so many (longs), of which each word flips one bit."""
    ratio = F.log2(F.greatest(F.col("band"), F.lit(1)) / BYTES)
    longs = LONGS * F.pow(F.lit(2), F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(math.log2(TIMES)), ratio)))).cast("int")
    rows = texts.select("id", "path", "band", "extension", longs.alias("longs"), F.col("text").cast("binary").alias("text"))

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, longs, column = batch.drop_columns(["text"]), batch.column("longs").to_numpy(), batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            n, flips = sketch.sketches(data, offsets - offsets[0], longs)
            ends = np.append(0, np.cumsum(8 * longs)).astype(np.int32)
            s = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flips)])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int32()), s], [*kept.schema.names, "n", "s"])

    return rows.mapInArrow(made, "id bigint, path string, band bigint, extension string, longs int, n int, s binary")


def sketch_pairs(rows: DataFrame, least: float) -> DataFrame:
    """file1, file2, id1, id2, band, extension: pairs of a block that the sketches leave. A block's rows are dealt out by the hash of their path, and
    each two parts are held against each other in a cell, all numbers at once."""
    size = F.least(F.lit(SKETCHED), F.floor(F.lit(SKETCH_BYTES) / (8 * F.max("longs"))))
    parts = rows.groupBy("band", "extension").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    rows = rows.join(parts, ["band", "extension"]).withColumn("p", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = into_cells(rows.select("band", "extension", F.greatest("p", "q").alias("i"), F.least("p", "q").alias("j"), "p", "id", "path", "n", "s"))

    def pairs(key: tuple, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pieces).combine_chunks()
        band, extension, i, j = key
        p, n = table["p"].to_numpy(), table["n"].to_numpy()
        x, ids, paths = np.frombuffer(b"".join(table["s"].to_pylist()), np.uint64).reshape(len(p), -1), table["id"].to_numpy(), table["path"].combine_chunks()
        first, second = np.flatnonzero(p == i), np.flatnonzero(p == j)
        for a, b in sketch.close_pairs(x[first], n[first], x[second], n[second], least, i == j):
            a, b = first[a], second[b]
            file1, file2 = paths.take(pa.array(a)), paths.take(pa.array(b))
            below, above = (f(file1, file2).to_numpy(zero_copy_only=False) for f in (pc.less, pc.greater))
            a, b = np.concatenate([a[below], b[above]]), np.concatenate([b[below], a[above]])
            ends = [paths.take(pa.array(a)), paths.take(pa.array(b)), pa.array(ids[a]), pa.array(ids[b])]
            yield pa.RecordBatch.from_arrays([*ends, pa.repeat(pa.scalar(band, pa.int64()), len(a)), pa.repeat(pa.scalar(extension), len(a))], ["file1", "file2", "id1", "id2", "band", "extension"])

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, []
        for key, piece in cells(batches):
            if key != last and pieces:
                yield from pairs(last, pieces)
                pieces = []
            last = key
            pieces.append(piece)
        if pieces:
            yield from pairs(last, pieces)

    return rows.mapInArrow(made, "file1 string, file2 string, id1 bigint, id2 bigint, band bigint, extension string")


def alike_texts(texts: DataFrame, least: float, threshold: float | None = None) -> DataFrame:
    """file1, file2, value: pairs of texts (id, path, band, extension, text) of a block (band, extension) whose word sets have the
    Jaccard similarity least at least, which is the value. Given a threshold, the value is the combined similarity of the normalised texts, of pairs that reach
    it. All pairs of a block are held against each other by sketches: bits that differ are words that aren't shared, at
    least. What that leaves is decided on the words, then by edit distances, in cells of texts: a text is sent to a cell once, however many pairs it has there."""
    known = F.col("text").isNotNull() & F.col("path").isNotNull() & F.col("band").isNotNull() & F.col("extension").isNotNull()
    texts = texts.where(known)
    found = materialise(sketch_pairs(materialise(sketched(texts), "near-sketches"), least), "near-candidates")
    ends = found.select("band", "extension", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    parts = ends.groupBy("band", "extension").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(COMPARED), F.floor(F.lit(COMPARED_BYTES) / F.greatest(F.col("band"), F.lit(1)))))).alias("parts"))
    g, h = (F.pmod(F.xxhash64(c), F.col("parts")).cast("int") for c in ("id1", "id2"))
    pairs = found.join(parts, ["band", "extension"]).select("band", "extension", F.least(g, h).alias("i"), F.greatest(g, h).alias("j"), "id1", "id2", "file1", "file2")
    body = F.col("text") if threshold is None else text.normalise(F.col("text"))
    docs = texts.join(ends.select("id").distinct(), "id", "left_semi").select("id", body.cast("binary").alias("text"))
    docs = pairs.select(*CELL, F.explode(F.array("id1", "id2")).alias("id")).distinct().join(docs, "id")
    docs = docs.select(*CELL, F.lit(0).alias("kind"), F.col("id").alias("id1"), F.lit(None).cast("bigint").alias("id2"), *(F.lit(None).cast("string").alias(f"file{k}") for k in (1, 2)), "text")
    rows = docs.unionByName(pairs.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("binary")}))

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, docs, waiting, held = None, {}, [], 0
        for key, piece in cells(batches):
            if key != last:
                last, docs = key, {}
            for kind, id1, id2, file1, file2, body in zip(*(piece.column(c).to_pylist() for c in ("kind", "id1", "id2", "file1", "file2", "text")), strict=True):
                if kind == 0:
                    docs[id1] = sketch.Text(body)
                    held += len(body)
                else:
                    waiting.append((file1, file2, docs[id1], docs[id2]))
                if len(waiting) >= AT_ONCE or (held >= HELD and waiting):
                    yield pa.RecordBatch.from_arrays(*sketch.valued(waiting, least - EPS, threshold, EPS))
                    waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays(*sketch.valued(waiting, least - EPS, threshold, EPS))

    return into_cells(rows, "kind").mapInArrow(made, "file1 string, file2 string, value double")


def least_words(threshold: float) -> float:
    """As the edit similarity is 1 at most, the words' similarity is this at least."""
    return (threshold - text.ALPHA) / text.BETA


def numbered(files: DataFrame) -> DataFrame:
    """files (path, extension, text and others) with an id of each row, written."""
    return materialise(files.withColumn("id", F.monotonically_increasing_id()), "near-texts", "zstd")


def text_candidates(files: DataFrame, threshold: float) -> DataFrame:
    """file1, file2, words: pairs of a block (band, extension) whose word sets' Jaccard similarity, words, may reach
    the threshold. Files without words match among themselves alone (words 1). With a threshold of 0.6 or less all pairs of a block are given."""
    rows = numbered(files.select("path", "band", "extension", "text"))
    return alike_texts(rows, least_words(threshold)).withColumnRenamed("value", "words")


def text_pairs(files: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """file1, file2, similarity, algorithm of the pairs of text files (path, size, extension, text) whose similarity is the
    threshold or more. Files are in the same size band and have the same extension. What the words
    leave open bounds the difference of the lengths and the edit distance. White space doesn't change the words, so only texts of pairs that the
    sketches leave are normalised."""
    t = options.threshold
    files = files.where(F.col("extension").isin(*options.text_extensions) & (F.col("size") <= options.max_text_bytes))
    # Written before the bands, which take the sizes twice.
    rows = with_bands(numbered(files.select("path", "size", "extension", "text")), TEXT_TOLERANCE)
    return alike_texts(rows, least_words(t), t).select("file1", "file2", F.col("value").alias("similarity"), F.lit("combined").alias("algorithm"))


def image_pairs(images: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of images (path, extension, hash, signature) with the same extension. hash: 64 bits as a string. All pairs are compared."""
    rows = materialise(images.select("extension", "path", bits.packed(F.col("hash")).alias("packed"), "signature"), "near-images")
    differing = bits.packed_hamming(F.col("x_packed"), F.col("y_packed"))
    similar = color.image_similarity(differing, F.col("x_signature"), F.col("y_signature"))
    return scored(dealt_pairs(rows, rows, ["extension"], True), similar, threshold).withColumn("algorithm", F.lit("combined"))


def media_pairs(files: DataFrame, kind: str, threshold: float = 0.85) -> DataFrame:
    """Of videos or audio files (path, size, media_type, media_fingerprint) in the same size band. Bands run over all files of the
    kind; those without a fingerprint have no pairs. All pairs of a band are compared, as numbers of 64 bits; those with a fingerprint of
    more than bits.HEAD of them, or of other signs than 0 and 1, in a join of their own."""
    mark = F.col("media_fingerprint")
    rows = with_bands(files.where(F.col("media_type") == kind), MEDIA_TOLERANCE).where(mark.isNotNull())
    plain, n = bits.plain_bits(mark), F.length(bits.fingerprint_bits(mark))
    rows = rows.select("band", "path", mark, n.alias("n"), plain.alias("plain"), (plain & (n <= 64 * bits.HEAD)).alias("short"), F.when(plain, bits.fingerprint_words(mark)).alias("words"))
    heads = [c for k in range(bits.HEAD) for c in (F.get("words", F.lit(k)).alias(f"w{k}"), bits.word_mask(F.col("n"), 64 * k).alias(f"m{k}"))]
    rows = materialise(rows.select("*", *heads), "near-media")
    a, b, v, w = ([F.col(f"{s}{k}") for k in range(bits.HEAD)] for s in ("x_w", "y_w", "x_m", "y_m"))
    x, y = F.col("x_n"), F.col("y_n")
    head = bits.share_alike(bits.head_distance(a, b, v, w, x, y), x, y)
    short = rows.where("short")
    some = short.drop("media_fingerprint", "plain", "short", "words")
    found = scored(dealt_pairs(some, some, ["band"], True), head, threshold)
    long = rows.where("NOT short")
    if not long.isEmpty():
        both = F.col("x_plain") & F.col("y_plain")
        # The lengths, then the first words rule most pairs out.
        may = (bits.share_alike(F.abs(x - y), x, y) >= threshold) & (~both | (head >= threshold))
        similar = F.when(both, bits.share_alike(bits.words_distance(F.col("x_words"), F.col("y_words"), x, y), x, y)).otherwise(
            bits.fingerprint_similarity(F.col("x_media_fingerprint"), F.col("y_media_fingerprint"))
        )
        for other, within in ((long, True), (short, False)):
            found = found.unionByName(scored(dealt_pairs(long, other, ["band"], within).where(may), similar, threshold))
    return found.select("file1", "file2", "similarity", F.lit(f"{kind}-fingerprint").alias("algorithm"), F.lit(kind).alias("media_type"))


def hamming_search(queries: DataFrame, rows: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """query_id, id, distance of the queries (query_id, query: a long) and rows (id, packed: a long) that differ in radius bits
    at most. All rows are gone through for each block of queries, which are block or so and broadcast."""
    blocks = max(1, -(-queries.count() // block))
    found = None
    for k in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        distance = bits.packed_hamming(F.col("packed"), F.col("query"))
        part = rows.join(F.broadcast(some), distance <= radius).select("query_id", "id", distance.alias("distance"))
        found = part if found is None else found.unionByName(part)
    return found


def near_members(pairs: DataFrame, kind: str) -> DataFrame:
    """group_root, type, path, similarity, max_edge_similarity, n_files, avg_edge_similarity: a row for each file in a group, that
    is a connected component of the pairs. similarity is 1 for each member, as groups are reported; the other two
    are of the pairs themselves."""
    labels = components(pairs.select("file1", "file2"), "file1", "file2")
    ends = pairs.select(F.col("file1").alias("path"), "similarity").unionByName(pairs.select(F.col("file2").alias("path"), "similarity"))
    best = ends.groupBy("path").agg(F.max("similarity").alias("max_edge_similarity"))
    named = labels.withColumnRenamed("node", "path").withColumnRenamed("root", "group_root")
    edges = pairs.join(named.withColumnRenamed("path", "file1"), "file1").groupBy("group_root").agg(F.avg("similarity").alias("avg_edge_similarity"))
    sizes = named.groupBy("group_root").agg(F.count(F.lit(1)).alias("n_files"))
    return named.join(best, "path").join(sizes, "group_root").join(edges, "group_root").select(
        "group_root", F.lit(kind).alias("type"), "path", F.lit(1.0).alias("similarity"), "max_edge_similarity", "n_files", "avg_edge_similarity"
    )


def near_groups(members: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """id, type, number, files, avg_similarity, avg_edge_similarity: a row for each group, for reports, numbered by similarity and root within
    the type. Numbers are given by ranges of that order, without the files, so no task has all groups. Files carry the root
    they came from, if files (path, source_root) are given."""
    if files is not None:
        members = members.join(files.select("path", "source_root"), "path", "left")
    else:
        members = members.withColumn("source_root", F.lit(None).cast("string"))
    rows = members.groupBy("type", "group_root").agg(
        F.array_sort(F.collect_list(F.struct("path", "similarity", "source_root", "max_edge_similarity"))).alias("files"), F.avg("similarity").alias("avg_similarity"), F.first("avg_edge_similarity").alias("avg_edge_similarity")
    )
    order = (F.desc("avg_similarity"), F.asc("group_root"))
    roots = members.groupBy("type", "group_root").agg(F.avg("similarity").alias("avg_similarity"))
    roots = materialise(roots.repartitionByRange("type", *order).withColumn("part", F.spark_partition_id()), "near-roots")
    before = Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = roots.groupBy("type", "part").count().select("type", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.row_number().over(Window.partitionBy("type", "part").orderBy(*order))
    numbers = roots.join(F.broadcast(starts), ["type", "part"]).select("type", "group_root", number.alias("number"))
    return rows.join(numbers, ["type", "group_root"]).select(
        F.concat_ws("-", "type", F.col("number").cast("string")).alias("id"), "type", "number", "files", "avg_similarity", "avg_edge_similarity"
    )


def near_summary(members: DataFrame) -> DataFrame:
    """type, n_groups, n_files: the files in groups of each type."""
    return members.groupBy("type").agg(F.countDistinct("group_root").alias("n_groups"), F.count(F.lit(1)).alias("n_files"))


def threshold_of(percent: str | float) -> float:
    """A threshold given in per cent, of which fractions are cut off."""
    return math.trunc(float(percent)) / 100
