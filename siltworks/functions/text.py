"""Text functions. White space is that of ECMAScript's \\s; words are runs of ASCII letters, digits and _, in
the case they are in, so text in other scripts has none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
ALPHA, BETA = 0.6, 0.4


def normalise(text: Column) -> Column:
    """Runs of white space become one blank; none stays at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, "[^A-Za-z0-9_]+"), ""))


def word_hashes(text: Column) -> Column:
    """The word set as 64-bit hashes. \\W is the same class of signs as in word_set, and Java looks it up several times as fast."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, "\\W+"), ""), lambda x: F.xxhash64(x)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of words: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / F.greatest(union, F.lit(1)))


def edit_similarity(distance: Column, n: Column, m: Column) -> Column:
    longest = F.greatest(n, m)
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / F.greatest(longest, F.lit(1)))


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Without what both begin and end with, the shorter first."""
    k = common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    return (b, a) if len(a) > len(b) else (a, b)


def distance(a: str, b: str, room: int | None = None, first: int = 256) -> int | None:
    """Levenshtein distance in code points, None if it is more than room. What is looked at is a band around the table's
    diagonal, one of first: near texts differ little, so the time is about that of reading them."""
    a, b = trimmed(a, b)
    room = len(b) if room is None else min(room, len(b))
    if len(b) - len(a) > room:
        return None
    if not a:
        return len(b)
    k = max(first, len(b) - len(a))
    while k < room:
        if (found := banded(a, b, k)) is not None:
            return found
        k *= 4
    return banded(a, b, room)


def banded(a: str, b: str, k: int) -> int | None:
    """The distance if it is k or less (Myers, "A Fast Bit-Vector Algorithm for Approximate String Matching", 1999; Hyyrö, "A
    Bit-Vector Algorithm for Computing Levenshtein and Damerau Edit Distances", 2003): of each column the 2 * k + 1 rows around the
    diagonal, whose steps up and down from row to row are the bits of two integers. len(a) <= len(b) <= len(a) + k."""
    rows, width = len(a), 2 * k + 1
    mask, last = (1 << width) - 1, 1 << width - 1
    up, down = mask ^ ((1 << k) - 1), 0
    score = min(k, rows)
    run = max(1024, width)
    column = 0
    for start in range(0, len(b), run):
        low = max(0, start - k)
        places: dict[str, int] = {}
        for i, c in enumerate(a[low : start + run + k]):
            places[c] = places.get(c, 0) | 1 << i
        for c in b[start : start + run]:
            shift = column - k - low
            column += 1
            same = places.get(c, 0)
            same = (same >> shift if shift >= 0 else same << -shift) & mask
            diagonal = ((((same & up) + up) ^ up) | same | down) & mask
            more = (down | ~(diagonal | up)) & mask
            less = diagonal & up
            if column + k <= rows:
                score += not diagonal & last
            else:
                at = rows - column + k
                score += (more >> at & 1) - (less >> at & 1)
                if score - (len(b) - column) > k:
                    return None
            diagonal >>= 1
            up = (less | ~(diagonal | more)) & mask
            down = diagonal & more
    return score if score <= k else None


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series, room: pd.Series) -> pd.Series:
    """Null where it is more than room."""
    return pd.Series([distance(x, y, int(r)) for x, y, r in zip(a, b, room)], dtype="Int32")


def combined(edit: Column, words: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ALPHA * edit + BETA * words))


def text_similarity(a: Column, b: Column) -> Column:
    """Of two normalised texts: 0.6 of the edit similarity and 0.4 of the words' Jaccard similarity."""
    return combined(edit_similarity(F.levenshtein(a, b), F.length(a), F.length(b)), jaccard(word_set(a), word_set(b)))
