"""Temperature mixing: token shares of the sources to the power of an exponent, found by bisection so that a
target holds, and the budgets that follow, dealt out as permutations of blocks of documents."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Documents of a block, about; a block is permuted in one task.
BLOCK_DOCS = 1000
#: Sources that the driver holds at most; with more, sums for the bisection come from the executors.
DRIVER_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """repetition: no document is taken more often than so on average. entropy: of the weights, as a share of
    that of equal weights (None: only the repetition limits). budget: tokens of the mixture; None: so many
    that the largest source is taken once and no document is left out."""

    repetition: float = 2.0
    entropy: float | None = None
    budget: float | None = None


def bisect(holds, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The least exponent at which holds() is true; it is at high, and stays so from where it begins."""
    if holds(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        if holds(mid):
            high = mid
        else:
            low = mid
    return high


def sums_of(sources: DataFrame, total: float):
    """A function of the exponent a: sum of p**a, and of p**a * log(p), over the sources' token shares p."""
    if sources.count() <= DRIVER_SOURCES:
        p = sources.select("tokens").toPandas()["tokens"].to_numpy(float) / total
        return lambda a: (float((p**a).sum()), float((p**a * np.log(p)).sum()))
    p = F.col("tokens") / total

    def sums(a):
        return tuple(sources.agg(F.sum(F.pow(p, a)), F.sum(F.pow(p, a) * F.log(p))).first())

    return sums


def exponent(sources: DataFrame, target: Target) -> tuple[float, float, float]:
    """The exponent, the sum of powered shares, and the tokens of the mixture. Sources (source, tokens > 0).
    The least exponent is taken at which no source is repeated more than the limit; with an entropy target,
    the larger of that and the one that meets the entropy. Where even an exponent of 1 repeats too often
    (a budget beyond repetition * all tokens), it is 1."""
    total, most, least, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 1.0, 0.0
    total = float(total)
    sums = sums_of(sources, total)

    def budget(a: float, z: float) -> float:
        return target.budget or most / ((most / total) ** a / z)

    def limited(a: float) -> bool:
        z = sums(a)[0]
        return budget(a, z) * (least / total) ** a / z <= target.repetition * least * (1 + 1e-9)

    def spread(a: float) -> bool:
        z, s = sums(a)
        return math.log(z) - a * s / z <= target.entropy * math.log(n) + 1e-12

    a = bisect(limited)
    if target.entropy is not None and n > 1:
        a = max(a, bisect(spread))
    z = sums(a)[0]
    return a, z, budget(a, z)


def temperature_mix(docs: DataFrame, target: Target = Target(), seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, mix_key of each document taken, once for each time it is taken. docs: doc_id, text, source; tokens are pieces between blanks, null texts count
    one, a null source is a source of its own, and repeated rows are documents of their own.

    A source's documents are dealt to blocks by hash; in each epoch its blocks come in an order of their own,
    and so do the documents in a block. A source is gone through until its budget is used: full epochs, then
    blocks, then documents of the last block, so a budget is met within one document. mix_key: the share of
    the source's budget that comes before; ordered by it, the sources run side by side at their weights.

    Only counts and sums are gathered: per source on the driver, per block in a window, which has one row for
    BLOCK_DOCS documents. Hot sources are many blocks."""
    out, (n, e, b, at, until) = taken(docs, target, seed, ())
    return out.select("doc_id", "source", F.col(n).alias("n_tokens"), F.col(e).alias("epoch"), F.col(b).alias("block"), (F.col(at) / F.col(until)).alias("mix_key"))


def taken(docs: DataFrame, target: Target, seed: int, keep: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """The documents taken with doc_id, source, the columns in keep, and others, whose names are the second result."""
    h, n, b, sk, e, until, at, inside, offset, all_ = fresh(docs, *(f"mix_{x}" for x in ("hash", "tokens", "block", "source", "epoch", "until", "at", "inside", "offset", "all")))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # no null, so joins and windows are dealt by the same key
    rows = docs.select("doc_id", "source", *keep, name.alias(sk), words.alias(n), F.xxhash64("doc_id", F.crc32(text.cast("binary")), F.lit(seed)).alias(h))
    if not keep:
        rows = materialise(rows, "mix-rows")
    sources = materialise(rows.groupBy(sk).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    a, z, budget = exponent(sources, target)
    total = float(sources.agg(F.sum("tokens")).first()[0] or 1)
    plan = sources.select(
        sk, F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias(b), F.col("tokens").alias(all_),
        F.round(F.pow(F.col("tokens") / total, a) / z * budget).cast("long").alias(until),
    )
    epochs = F.sequence(F.lit(0), (F.ceil(F.col(until) / F.col(all_)) - 1).cast("int"))
    dealt = rows.join(plan, sk).withColumn(b, F.pmod(F.col(h), F.col(b))).withColumn(e, F.explode(epochs))
    sizes = dealt.groupBy(sk, e, b).agg(F.sum(n).alias(inside))
    past = Window.partitionBy(sk, e).orderBy(F.xxhash64(F.col(b), F.col(e), F.lit(seed)), b).rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(sk, e, b, F.coalesce(F.sum(inside).over(past), F.lit(0)).alias(offset))
    own = Window.partitionBy(sk, e, b).orderBy(F.xxhash64(F.col(h), F.col(e), F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(inside, F.coalesce(F.sum(n).over(own), F.lit(0))).join(places, [sk, e, b])
    out = out.withColumn(at, F.col(e) * F.col(all_) + F.col(offset) + F.col(inside)).where(F.col(at) < F.col(until))
    return out, (n, e, b, at, until)


def mixed(docs: DataFrame, target: Target = Target(), seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with their columns alone."""
    return taken(docs, target, seed, tuple(c for c in docs.columns if c not in ("doc_id", "source")))[0].select(*docs.columns)
