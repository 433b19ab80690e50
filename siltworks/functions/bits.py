"""Perceptual hashes of pixel grids and fingerprints, as strings of 0 and 1, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def bits(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def average_hash(pixels: Column) -> Column:
    """A bit for each grey value: whether it is the mean or more."""
    return let(mean(pixels), lambda average: bits(F.transform(pixels, lambda p: p.cast("double") >= average)))


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Row by row a bit for each grey value but a row's last: whether the one to its right is larger."""
    places = F.array(*(F.lit(y * width + x) for y in range(height) for x in range(width - 1)))
    return bits(F.transform(places, lambda i: F.get(pixels, i) < F.get(pixels, i + 1)))


def hamming(a: Column, b: Column) -> Column:
    """Places of a where b differs, or has nothing."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: (i <= F.length(a)) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))))


def packed(hash_: Column) -> Column:
    """64 bits as a long."""
    high, low = F.conv(F.substring(hash_, 1, 32), 2, 10).cast("long"), F.conv(F.substring(hash_, 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def packed_hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint(version: str, n: Column, bit_string: Column) -> Column:
    """version:n:bits:check, the check 16 hex digits of the bits' SHA-256."""
    return F.concat_ws(":", F.lit(version), n.cast("string"), bit_string, F.substring(F.sha2(bit_string, 256), 1, 16))


def fingerprint_bits(mark: Column) -> Column:
    return F.coalesce(F.get(F.split(mark, ":"), F.lit(2)), F.lit(""))


def fingerprint_distance(a: Column, b: Column) -> Column:
    """Differing bits over the shorter length, and the difference of the lengths."""
    x, y = fingerprint_bits(a), fingerprint_bits(b)
    n = F.least(F.length(x), F.length(y))
    return hamming(F.substr(x, F.lit(1), n), F.substr(y, F.lit(1), n)) + F.abs(F.length(x) - F.length(y))


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """1 less the distance as a share of the longer one; 0 if either is empty; null if either is null."""
    x, y = F.length(fingerprint_bits(a)), F.length(fingerprint_bits(b))
    similar = F.greatest(F.lit(0.0), 1 - fingerprint_distance(a, b) / F.greatest(x, y, F.lit(1)))
    return F.when(a.isNull() | b.isNull(), None).when((x == 0) | (y == 0), 0.0).otherwise(similar)


#: Words of 64 bits of a fingerprint that are compared as columns: those of five frames.
HEAD = 5


def plain_bits(mark: Column) -> Column:
    """Whether a fingerprint's bits are 0 and 1 alone."""
    return fingerprint_bits(mark).rlike("\\A[01]*\\z")


def fingerprint_words(mark: Column) -> Column:
    """The bits of a fingerprint with plain bits, 64 in a long, the last one filled up with 0; HEAD longs at least."""
    x = fingerprint_bits(mark)
    words = F.greatest(F.lit(HEAD), F.ceil(F.length(x) / 64).cast("int"))
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: packed(F.rpad(F.substr(x, i * 64 + 1, F.lit(64)), 64, "0")))


def word_mask(n: Column, before: Column | int) -> Column:
    """The bits that a fingerprint of n bits has of a word of it, where so many bits come before, as a long of ones."""
    own = F.least(F.lit(64), F.greatest(F.lit(0), n - before))
    return F.when(own == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), 64 - own))


def head_distance(a: list[Column], b: list[Column], masks_a: list[Column], masks_b: list[Column], n: Column, m: Column) -> Column:
    """fingerprint_distance of plain fingerprints of n and m bits by their first HEAD words and their masks, given as columns: exact if
    neither is longer, else the distance is no less."""
    both = zip(a, b, masks_a, masks_b)
    return sum((F.bit_count(x.bitwiseXOR(y).bitwiseAND(v).bitwiseAND(w)) for x, y, v, w in both), F.abs(n - m))


def words_distance(a: Column, b: Column, n: Column, m: Column) -> Column:
    """fingerprint_distance of plain fingerprints of n and m bits, by their words."""
    words = F.least(F.size(a), F.size(b))
    least = F.least(n, m)
    each = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)).bitwiseAND(word_mask(least, 64 * i))))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x) + F.abs(n - m)


def share_alike(distance: Column, n: Column, m: Column) -> Column:
    """The similarity of fingerprints of n and m bits with that distance."""
    return F.when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / F.greatest(n, m, F.lit(1))))


def frame_schedule(duration: Column, most: int = 5) -> Column:
    """When frames of a video are taken, in seconds: one for two seconds, at least one, evenly spread."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(duration / 2).cast("int")))
    return F.transform(F.sequence(F.lit(1), n), lambda i: duration / (n + 1) * i)


def video_fingerprint(frames: Column, requested: Column) -> Column:
    """Of the hashes of a video's frames, null if there is none."""
    return F.when(F.size(frames) > 0, fingerprint("v1", requested, F.array_join(frames, "")))
