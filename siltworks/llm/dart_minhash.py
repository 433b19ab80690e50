"""Near-duplicates by DartMinHash (Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020): darts
are thrown into the regions of a document's weighted shingles; the earliest dart in each coordinate is the
document's weighted minhash there. Bands of coordinates give candidates, exact similarity decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import fresh, materialise

#: Words of a shingle.
SHINGLE = 5
#: Cells of dart regions that are worked on at a time.
CELLS = 1 << 19
#: Most darts in a unit cell, whose number is Poisson(1); more have probability below 1e-16.
MOST = 18
POISSON = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(1, MOST)])


@dataclass(frozen=True)
class Banding:
    """coordinates = bands * rows. Two texts of similarity 0.8 meet in one of 24 bands of 6 rows with
    probability 0.9993, of 0.85 with 0.99999. sketch_bits: of the sketch that rules pairs out."""

    bands: int = 24
    rows: int = 6
    similarity: float = 0.8
    sketch_bits: int = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that scatters them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's runs of SHINGLE words (white space is ASCII's); a text of fewer words is one run,
    one without words has none. Repeated runs are repeated."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hash_word, words), np.uint64, len(words))
    n = max(1, len(ids) - SHINGLE + 1)
    out = np.full(n, len(ids) if len(ids) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return out


def hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The set of shingles and the weight of each, how often it occurs."""
    x, n = np.unique(shingles(text), return_counts=True)
    return x, n.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over that of the larger; 0 if either has no shingle."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def thrown(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int):
    """Darts of rank below limit[doc] in the regions of the elements: document, coordinate, rank, identity.
    An element's plane of weight and rank is cut into cells of one by one, each with a number of darts, and a
    place for each, that only hashes of element and cell decide; a dart counts if its place is below both."""
    across = np.ceil(weights).astype(np.int64)
    up = np.ceil(limit[doc]).astype(np.int64)
    n = across * up
    own = np.repeat(np.arange(len(elements)), n)
    cell = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    column, row = cell // up[own], cell % up[own]
    seed = mix(elements[own] + mix((column.astype(np.uint64) << np.uint64(32)) + row.astype(np.uint64) + np.uint64(1)))
    darts = np.searchsorted(POISSON, unit(mix(seed + np.uint64(0x9E3779B97F4A7C15))), side="right")
    hit = np.flatnonzero(darts)
    which = np.repeat(hit, darts[hit])
    nth = np.arange(len(which)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
    identity = mix(seed[which] + (nth.astype(np.uint64) + np.uint64(2)) * np.uint64(0xD1B54A32D192ED03))
    weight = column[which] + unit(mix(identity + np.uint64(1)))
    rank = row[which] + unit(mix(identity + np.uint64(2)))
    element = own[which]
    good = (weight < weights[element]) & (rank < limit[doc[element]])
    identity = identity[good]
    return doc[element[good]], (mix(identity + np.uint64(3)) % np.uint64(k)).astype(np.int64), rank[good], identity


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[np.ndarray | None]:
    """For each weighted set the identity of the earliest dart in each of k coordinates, None for an empty
    set. So many darts are looked at that about k log k + 2k count; where a coordinate stays empty, twice as
    many. Sets are worked on together, cut where CELLS cells would be exceeded."""
    out: list[np.ndarray | None] = [None] * len(sets)
    todo = [(i, (k * np.log(k) + 2 * k) / s[1].sum()) for i, s in enumerate(sets) if len(s[0])]
    while todo:
        part, cells = [], 0
        while todo and (not part or cells + np.ceil(sets[todo[-1][0]][1]).sum() * np.ceil(todo[-1][1]) <= CELLS):
            i, limit = todo.pop()
            cells += np.ceil(sets[i][1]).sum() * np.ceil(limit)
            part.append((i, limit))
        doc = np.repeat(np.arange(len(part)), [len(sets[i][0]) for i, _ in part])
        d, c, rank, identity = thrown(np.concatenate([sets[i][0] for i, _ in part]), np.concatenate([sets[i][1] for i, _ in part]), doc, np.array([x for _, x in part]), k)
        order = np.lexsort((rank, d * k + c))
        place = (d * k + c)[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        grid, filled = np.zeros(len(part) * k, np.uint64), np.zeros(len(part) * k, bool)
        grid[place[first]] = identity[order][first]
        filled[place[first]] = True
        full = filled.reshape(-1, k).all(axis=1)
        for j, (i, limit) in enumerate(part):
            if full[j]:
                out[i] = grid[j * k : (j + 1) * k]
            else:
                todo.append((i, 2 * limit))
    return out


def odd_sketch(x: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each hash value, flipped by every unit of weight there. The bits in which two sketches
    differ are never more than the weight that the sets don't share, so a bound on them loses no pair."""
    units = np.repeat(x, n.astype(np.int64))
    units = mix(units + (np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n.astype(np.int64))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = (np.bincount((units % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def sketched(texts: DataFrame, banding: Banding) -> DataFrame:
    """key, weight, sketch, buckets of each row of texts (key, text) that has words. buckets: a hash for each
    band, of the band and its coordinates."""
    k = banding.bands * banding.rows

    def run(batches):
        odd = np.arange(1, 2 * banding.rows, 2, dtype=np.uint64)
        salt = np.arange(1, banding.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            held, keys, size = [], [], 0
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1)), 1):
                s = weighted(text.as_py())
                if len(s[0]):
                    held.append(s)
                    keys.append(key)
                    size += len(s[0])
                if held and (size > CELLS // 4 or i == batch.num_rows):
                    grid = np.stack(signatures(held, k)).reshape(len(held), banding.bands, banding.rows)
                    buckets = mix((mix(grid) * odd).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                    sketch = np.stack([odd_sketch(*s, banding.sketch_bits) for s in held])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array([int(s[1].sum()) for s in held], pa.int64()), listed(sketch), listed(buckets)],
                        names=["key", "weight", "sketch", "buckets"],
                    )
                    held, keys, size = [], [], 0

    return texts.select("key", "text").mapInArrow(run, "key long, weight long, sketch array<long>, buckets array<long>")


def listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel().astype(np.int64)))


def near(a: str, b: str, banding: Banding):
    """Whether the sketches of two rows, named a and b, leave the similarity possible: of weights v and w,
    (1 - s) / (1 + s) * (v + w) may be unshared at most."""
    words = banding.sketch_bits // 64
    unlike = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(1, words)), F.bit_count(F.get(f"{a}.sketch", F.lit(0)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(0)))))
    s = banding.similarity
    return unlike <= (1 - s) / (1 + s) * (F.col(f"{a}.weight") + F.col(f"{b}.weight")) + 1e-6


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs whose texts' exact similarity is least or more."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, tuple] = {}
        out = []
        for left, right in zip(x, y):
            if left not in known:
                known.clear()
                known[left] = weighted(left)
            out.append(similarity(known[left], weighted(right)) >= least - 1e-12)
        return pd.Series(out, dtype=bool)

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(alike("x", "y")).select("a", "b")


def text_key():
    """The key of a text: a hash of 64 bits, of which among 10**9 texts two are equal by chance with
    probability 0.03. Null texts aren't copies of one another: their key is one of doc_id."""
    return F.when(F.col("text").isNull(), F.xxhash64(F.lit("null"), F.col("doc_id"))).otherwise(F.xxhash64("text"))


def near_classes(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """node, root: keys of the texts of docs (doc_id, text) that have a near copy, and the smallest key of
    their class: the component of the graph of pairs that share a bucket and have the similarity.

    Equal texts are one key, so groups of copies never meet as pairs. In each bucket all members are compared
    with one pivot: that which has most company in its buckets, which in a group of edited copies is near their
    origin. Then the members that aren't linked to their pivot's component are held against the rest of their
    bucket by sketch and weight, inside the join, and what may be similar is compared. So no pair that shares
    a bucket is missed, and a group that is linked isn't gone through pair by pair."""
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("key"), "text")
    sketches = materialise(sketched(texts, banding).dropDuplicates(["key"]), "near-sketches")
    rows = sketches.select("key", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialise(rows.join(shared, "bucket"), "near-buckets")
    company = rows.groupBy("key").agg(F.sum("n").alias("company"))
    members = materialise(company.join(sketches.drop("buckets"), "key"), "near-members")
    texts = materialise(texts.join(members.select("key"), "key", "left_semi").dropDuplicates(["key"]), "near-texts")

    top = F.max(F.struct("company", "key")).alias("top")
    pivots = rows.join(members.select("key", "company"), "key").groupBy("bucket").agg(top).select("bucket", F.col("top.key").alias("pivot"))
    pairs = rows.join(pivots, "bucket").where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    found = materialise(verified(likely(pairs, members, banding), texts, banding.similarity), "near-links")
    labels = components(found)
    placed = rows.where("n > 2").join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    main = placed.join(pivots, "bucket").where("key = pivot").select("bucket", F.col("root").alias("main"))
    apart = placed.join(main, "bucket").where("root != main").select("bucket", "key", "root")
    x = apart.join(members, "key").select("bucket", "key", "root", "weight", "sketch").alias("x")
    y = placed.join(members, "key").join(apart.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "key", "root", "weight", "sketch").alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & near("x", "y", banding))
    rest = rest.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    more = materialise(verified(rest, texts, banding.similarity), "near-links")
    if more.isEmpty():
        return labels
    return components(found.unionByName(more))


def likely(pairs: DataFrame, members: DataFrame, banding: Banding) -> DataFrame:
    x, y = members.select(F.col("key").alias("a"), "weight", "sketch").alias("x"), members.select(F.col("key").alias("b"), "weight", "sketch").alias("y")
    return pairs.join(x, "a").join(y, "b").where(near("x", "y", banding)).select("a", "b")


def near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """doc_id, class_id, n_copies, kept of each row of docs (doc_id, text): the smallest doc_id of the class
    (equal texts, and texts linked by similarity), the rows in it, and whether this is the row with it. Rows
    that repeat doc_id and text repeat the result. Texts without words are copies of equal ones only; a null
    text is a class of its own, and a null doc_id is never kept unless its class has no other."""
    rows = docs.select("doc_id", text_key().alias("key"))
    labels = near_classes(docs, banding)
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    keys = keys.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = keys.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_copies"))
    keys = materialise(keys.join(classes, "root").select("key", "class_id", "n_copies"), "near-classes")
    return rows.join(keys, "key").select("doc_id", "class_id", "n_copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """The row with the smallest doc_id of each class, with all columns; of rows that repeat doc_id and text, one."""
    first, key = fresh(docs, "class_first", "text_key")
    labels = near_classes(docs, banding)
    rows = docs.select("doc_id", text_key().alias("key"))
    keys = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    keys = keys.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = materialise(keys.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias(first), F.col("f.key").alias(key)), "near-kept")
    marked = docs.withColumn(key, text_key())
    left = marked.join(kept.withColumnRenamed(key, f"{key}_"), (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")
    return left.dropDuplicates([key, "doc_id"]).select(*docs.columns)
