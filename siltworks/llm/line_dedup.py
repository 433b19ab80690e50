"""Line dedup by an exact set-similarity join: each line's words in order of rarity, prefix, length and positional
filters, a sketch that rules out what they leave, and Jaccard on the words themselves. Of two lines that are
alike the later goes. All is DataFrame operations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Cells of a table of one byte each that the driver holds: 2 ** CELL_BITS, by the highest bits of a hash.
CELL_BITS = 17
#: Cells that one row brings to the driver: 2 ** ROW_BITS.
ROW_BITS = 8
#: The byte of a cell of value 0; values go up to 63.
ZERO = 48
#: In a posting list of more lines, they are held against its earliest line first. Going through the pairs of shorter lists takes
#: little: filters are compiled code, and of a line's candidates few are written.
HOT = 512
#: Of so many earliest candidates a line's pairs are written.
FEW = 16
#: Marks posting words that may have so long a list, as their cells' words occur so often.
OFTEN = 1 << 30


@dataclass(frozen=True)
class Jaccard:
    """The least similarity as a fraction."""

    over: int = 4
    under: int = 5

    def overlap(self, n):
        """Words that a set of n shares with an alike one at least."""
        return F.ceil(self.over * n / self.under)

    def shares(self, common, total):
        """Whether sets of total words in all, so many of them common, are alike."""
        return (self.over + self.under) * common >= self.over * total


def split_lines(text):
    """Lines end at \\n; tabs are blanks. Looking for a tab takes much less than replacing it where there is none."""
    tab = F.lit("\t")
    return F.split(F.when(F.contains(text, tab), F.replace(text, tab, F.lit(" "))).otherwise(text), "\n")


def line_hashes(line):
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line, h1, h2 of each line with a word of docs (doc_id, text). Lines end at \\n;
    words are what stands between blanks and tabs. A line is known by both hashes, 128 bits."""
    x = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    return x.where(F.trim("line") != "").select("*", *line_hashes(F.col("line")))


def words(line):
    return F.array_remove(F.split(line, " "), "")


def cell_of(h):
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def mark_of(h):
    """A bit of six for a hash."""
    return F.call_function("shiftleft", F.lit(1), F.pmod(h, F.lit(6)).cast("int"))


def marks(spark: SparkSession, keys: DataFrame, h) -> bytearray:
    """A table of fixed size that tells of a hash whether it may be one of the keys'."""
    found = keys.select(cell_of(h).alias("cell"), mark_of(h).alias("m")).groupBy("cell").agg(F.bit_or("m").alias("n"))
    return cells(spark, found, lambda n: n)


def marked(table: bytearray, h):
    return (at(table, h) - ZERO).bitwiseAND(mark_of(h)) != 0


def text_keys():
    """128 bits of a text."""
    return F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(2), "text").alias("text_hash2")


def one_of_each(docs: DataFrame, by_row: DataFrame) -> DataFrame:
    """doc_id, text of docs, of rows with equal texts one at least, and few more unless there are too many texts to mark. by_row has the
    rows' doc_id, text_keys and whether they have a text."""
    first = by_row.where("has").groupBy("text_hash", "text_hash2").agg(F.min(F.xxhash64("text_hash", "text_hash2", "doc_id")).alias("h"))
    seen = marked(marks(docs.sparkSession, first, F.col("h")), F.xxhash64(*text_keys(), "doc_id"))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull() & seen)


def cells(spark: SparkSession, rows: DataFrame, value) -> bytearray:
    """A byte for each cell: ZERO and the value, from 0 to 63, of the sum of `n` over the rows (cell, n) there."""
    empty = spark.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("long").alias("n"))
    sums = rows.select("cell", F.col("n").cast("long").alias("n")).unionByName(empty).groupBy("cell").agg(F.sum("n").alias("n"))
    sums = sums.select("cell", (value(F.col("n")) + ZERO).cast("int").alias("v"))
    part = F.array_sort(F.collect_list(F.struct("cell", "v")))
    found = sums.groupBy(F.shiftright("cell", ROW_BITS).alias("part")).agg(F.array_join(F.transform(part, lambda x: F.char(x["v"])), "").alias("s"))
    return bytearray("".join(x.s for x in sorted(found.collect())).encode())


def taken(table: bytearray, h):
    """at as a long, for lambdas, which aren't compiled: Spark makes the array a constant, and to take an element is less than to cut
    out a byte. Java has one object for each such small number, so that the array stays small."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")[cell_of(h)]


def at(table: bytearray, h):
    """The byte of a hash's cell."""
    return F.ascii(F.substring(F.lit(table), cell_of(h) + 1, F.lit(1)))


def rank_of(n):
    return F.least(F.lit(63), F.floor(2 * F.log2(n + 1)))


def rarity(docs: DataFrame) -> bytearray:
    """For each cell twice the logarithm of how often its words occur."""
    flat = F.concat_ws(" ", split_lines(F.col("text")))
    w = docs.where(F.col("text").isNotNull()).select(F.explode(F.split(flat, " ")).alias("w")).where("w != ''")
    w = w.select(cell_of(F.xxhash64("w")).alias("cell"))
    # two cells in a group: Spark's faster hash table has room for 65,536
    odd = w.groupBy(F.shiftright("cell", 1).alias("two")).agg(F.count(F.lit(1)).alias("both"), F.sum(F.col("cell").bitwiseAND(1)).alias("odd"))
    one, other = F.struct((F.col("two") * 2).alias("cell"), (F.col("both") - F.col("odd")).alias("n")), F.struct((F.col("two") * 2 + 1).alias("cell"), F.col("odd").alias("n"))
    return cells(docs.sparkSession, odd.select(F.inline(F.array(one, other))), rank_of)


#: Of a line: its id, how many distinct words it has, and a sketch: `sketch` has a bit flipped by each word; for
#: lines of more than 64 words `sketch2` has those of half the words, so that both tell 128 bits.
FEATURES = ("id", "n", "sketch", "sketch2")


def line_sets(docs: DataFrame, firsts: DataFrame, ranks: bytearray, least: Jaccard) -> DataFrame:
    """FEATURES and prefix, the posting words of the rarest words in order, of each distinct line. A word is a number, its cell's rank in the
    highest byte and 56 bits of its hash. Words that clash are more alike than they should be, so no pair is lost."""

    def ranked(g):
        return F.shiftleft(taken(ranks, g), 56).bitwiseOR(F.shiftrightunsigned(g, 8))

    w = F.array_distinct(F.transform(F.split("line", " "), lambda x: F.xxhash64(x)))
    w = F.array_remove(w, F.xxhash64(F.lit("")))
    x = lines_of(docs).select("h1", "h2", F.sort_array(F.transform(w, ranked)).alias("w"))
    n = F.size("w")

    often = ZERO + min(63, int(2 * math.log2(HOT + 1)))

    def posting(v):
        return v.bitwiseAND(F.lit(OFTEN - 1)).cast("int").bitwiseOR(F.when(F.shiftright(v, 56) >= often, F.lit(OFTEN)).otherwise(F.lit(0)))

    def bit(one, v):
        return F.call_function("shiftleft", one, v.bitwiseAND(F.lit(63)).cast("int"))

    none = F.lit(0).cast("long")
    sketch = F.aggregate("w", none, lambda a, v: a.bitwiseXOR(bit(F.lit(1).cast("long"), v)))
    half = F.aggregate("w", none, lambda a, v: a.bitwiseXOR(bit(F.shiftright(v, 6).bitwiseAND(F.lit(1)), v)))
    prefix = F.transform(F.slice("w", F.lit(1), (n - least.overlap(n) + 1).cast("int")), posting)
    x = x.select("h1", "h2", F.struct(n.alias("n"), sketch.alias("sketch"), F.when(n > 64, half).otherwise(none).alias("sketch2"), prefix.alias("prefix")).alias("f"))
    x = x.groupBy("h1", "h2").agg(F.first("f").alias("f"))
    return materialise(x.join(firsts.select("h1", "h2", "id"), ["h1", "h2"]).select("id", "f.*"), "line-sets")


def postings(sets: DataFrame) -> DataFrame:
    """word, place, FEATURES: a row for each word of the prefix of each line."""
    return sets.select(F.posexplode("prefix").alias("place", "word"), *FEATURES)


def may_match(a: str, b: str, least: Jaccard):
    """Length filter, positional filter (alike lines have a first common word, from which on each has as many words
    as are needed), and sketch: words that aren't shared differ in bits, and are few."""
    (n, place, s, t), (n2, place2, s2, t2) = ([F.col(f"{x}{c}") for c in ("n", "place", "sketch", "sketch2")] for x in (a, b))
    length = least.under * F.least(n, n2) >= least.over * F.greatest(n, n2)
    left = least.shares(F.least(n - place, n2 - place2), n + n2)
    whole, half = s.bitwiseXOR(s2), t.bitwiseXOR(t2)
    unlike = F.when(F.least(n, n2) <= 64, F.bit_count(whole)).otherwise(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)))
    return length & left & ((least.over + least.under) * unlike <= (least.under - least.over) * (n + n2))


def pairs_of(x: DataFrame, y: DataFrame, where, least: Jaccard) -> DataFrame:
    """a < b, ids of lines of x and y that share a posting word and pass the filters, once for each such word."""
    found = (F.col("x.word") == F.col("y.word")) & where & may_match("x.", "y.", least)
    return x.alias("x").join(y.alias("y"), found).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def all_pairs(x: DataFrame, least: Jaccard) -> DataFrame:
    """pairs_of x and itself. As the line with fewer words (of equally many the earlier) has the first common word in a shorter
    prefix, only rows of these are taken on one side. This comes after the shuffle, which both sides share: Spark moves no filter with
    rand, which is below 1. That no column is null is said first, as Spark else says it of other columns on either side."""
    x = x.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("word", "place", *FEATURES)])).repartition("word")
    short = (least.over + least.under) * (F.col("n") - F.col("place")) >= 2 * least.over * F.col("n")
    fewer = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    return pairs_of(x.where(short.cast("int") > F.rand(0)), x, fewer, least)


def line_words(ids: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """id, line, n: the lines of these ids and how many distinct words they have. They are looked for in the texts again; tables of
    marks of fixed size rule out most texts that aren't a first occurrence's, and keep most other lines out of the shuffle. docs
    has each text, but maybe with the doc_id of a copy."""
    keys = materialise(ids.distinct().join(firsts.select("id", "text_hash", "h1", "h2"), "id"), "line-keys")
    spark = docs.sparkSession
    some = docs.where(marked(marks(spark, keys, F.col("text_hash")), F.xxhash64("text")))
    found = lines_of(some).where(marked(marks(spark, keys, F.col("h1")), F.col("h1"))).select("h1", "h2", "line")
    found = found.groupBy("h1", "h2").agg(F.first("line").alias("line")).join(keys, ["h1", "h2"])
    return materialise(found.select("id", "line", F.size(F.array_distinct(words(F.col("line")))).alias("n")), "line-words")


def alike(pairs: DataFrame, found: DataFrame, least: Jaccard) -> DataFrame:
    """a, b of the pairs whose lines, of the table that line_words makes, have the similarity."""
    a, b = (found.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    common = F.size(F.array_intersect(words(F.col("line_a")), words(F.col("line_b"))))
    return pairs.join(a, "a").join(b, "b").where(least.shares(common, F.col("n_a") + F.col("n_b"))).select("a", "b")


def later(pairs: DataFrame, found: DataFrame, least: Jaccard) -> DataFrame:
    """id of each b of the pairs that is alike one of its a."""
    return materialise(alike(pairs, found, least).select(F.col("b").alias("id")).distinct(), "line-later")


def later_lines(docs: DataFrame, sets: DataFrame, firsts: DataFrame, least: Jaccard = Jaccard()) -> DataFrame:
    """id of each line that an alike one comes before; ids are in the order of the lines. First each line is held against its earliest
    candidate alone, which removes most of a group of lines that are alike its earliest; in lists of more than HOT lines only the
    earliest line is a candidate. Lines that this doesn't remove are held against their FEW earliest candidates, which are written.
    Those that have more, or stand in lists of more than HOT lines, are then held against all the rest, all pairs of them."""
    spark, rows = docs.sparkSession, postings(sets)
    lists = rows.where(F.col("word") >= OFTEN).groupBy("word").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("leader"))
    lists = materialise(lists.where(F.col("many") > HOT).select("word", "leader"), "line-lists")
    hot = None if lists.isEmpty() else materialise(rows.join(lists, "word"), "line-hot")
    cold = rows if hot is None else rows.join(lists, "word", "left_anti")
    first = all_pairs(cold, least)
    if hot is not None:
        first = first.unionByName(pairs_of(hot.where("id = leader"), hot, F.col("x.id") < F.col("y.id"), least))
    tried = first.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("a"))
    tried = materialise(tried.select("b", F.slice("a", 1, FEW).alias("a"), (F.size("a") > FEW).alias("more")), "line-tried")
    written = tried.select(F.explode("a").alias("a"), "b")
    found = line_words(tried.select(F.col("b").alias("id")).unionByName(written.select(F.col("a").alias("id"))), firsts, docs)
    gone = later(tried.select(F.col("a")[0].alias("a"), "b"), found, least)
    rest = tried.where(F.size("a") > 1).join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
    gone = gone.unionByName(later(rest.select(F.explode(F.slice("a", 2, FEW)).alias("a"), "b"), found, least))
    left = materialise(tried.where("more").select(F.col("b").alias("id")).join(gone, "id", "left_anti"), "line-left")
    more = []
    if not left.isEmpty():
        few = postings(sets.join(left, "id", "left_semi"))
        few = materialise(few if hot is None else few.join(lists, "word", "left_anti"), "line-few")
        word = F.xxhash64("word")
        more.append(pairs_of(few, cold.where(marked(marks(spark, few, word), word)), F.col("x.id") > F.col("y.id"), least))
    if hot is not None:
        more.append(pairs_of(hot.join(gone, "id", "left_anti"), hot, F.col("x.id") > F.col("y.id"), least))
    if not more:
        return gone
    pairs = reduce(DataFrame.unionByName, more).distinct().join(written, ["a", "b"], "left_anti")
    pairs = materialise(pairs, "line-pairs")
    if pairs.isEmpty():
        return gone
    return gone.unionByName(later(pairs, line_words(pairs.select(F.explode(F.array("a", "b")).alias("id")), firsts, docs), least))


def line_decisions(docs: DataFrame, least: Jaccard = Jaccard()) -> DataFrame:
    """doc_id, text_hash, n_lines, n_removed, n_near, removed_lines of each row of docs (doc_id, text): its lines with a word, those that
    are removed because an equal or alike line comes before, by doc_id (null first), hash of the text and line number; of these, those
    that no equal line comes before; and the numbers of the removed ones from 0. Lines without a word stay. A null text has no lines. Rows
    that repeat doc_id and text have the same result, as if there were one. Which lines are alike is decided exactly; how many
    lines each is alike isn't told, as in a large group of alike lines they aren't all compared."""
    place, has = ("doc_id", "text_hash", "line_no"), F.col("text").isNotNull()
    numbered = F.transform(split_lines(F.col("text")), lambda x, i: F.struct(i.alias("line_no"), F.when(F.trim(x) != "", F.struct(*line_hashes(x))).alias("h")))
    numbered = F.filter(numbered, lambda x: x["h"].isNotNull())
    by_row = materialise(docs.select("doc_id", *text_keys(), has.alias("has"), numbered.alias("lines")), "line-rows")
    rows = by_row.where("has").select("doc_id", "text_hash", F.explode("lines").alias("x")).select(*place[:2], "x.line_no", "x.h.h1", "x.h.h2")
    firsts = rows.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("many")).select("h1", "h2", "many", "first.*").orderBy(*place)
    firsts = materialise(firsts.withColumn("id", F.monotonically_increasing_id()), "line-firsts")
    some = one_of_each(docs, by_row)
    sets = line_sets(some, firsts, rarity(some), least)
    gone = later_lines(some, sets, firsts, least)
    flags = firsts.join(gone.withColumn("near", F.lit(True)), "id", "left").where("many > 1 OR near")
    flags = flags.select("h1", "h2", F.struct(*place).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    why = F.when(~F.struct(*place).eqNullSafe(F.col("first")), 1).when(F.col("near"), 2).otherwise(0)
    seen = rows.join(flags, ["h1", "h2"]).withColumn("why", why).where("why > 0")
    doc, text, coded = "doc_id_", "text_hash_", F.col("line_no").cast("long") * 4 + F.col("why")
    by_doc = seen.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).agg(F.sort_array(F.collect_set(coded)).alias("c"))
    all_rows = by_row.select("doc_id", "text_hash", "has", F.when(F.col("has"), F.size("lines")).otherwise(0).cast("long").alias("n_lines"))
    out = all_rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("text_hash") == F.col(text)) & F.col("has"), "left")
    out = out.withColumn("c", F.coalesce("c", F.array().cast("array<bigint>")))
    return out.select(
        "doc_id", "text_hash", "n_lines", F.size("c").cast("long").alias("n_removed"),
        F.size(F.filter("c", lambda x: x % 4 == 2)).cast("long").alias("n_near"), F.transform("c", lambda x: F.shiftright(x, 2).cast("int")).alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame, least: Jaccard = Jaccard()) -> DataFrame:
    """docs with the removed lines cut from the text; all rows and columns stay."""
    doc, key, gone, mine = fresh(docs, "line_doc", "line_text", "line_gone", "line_key")
    found = line_decisions(docs, least).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(key), F.col("removed_lines").alias(gone)).dropDuplicates([doc, key])
    x = docs.withColumn(mine, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(key)), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(gone), i))
    return x.withColumn("text", F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)
