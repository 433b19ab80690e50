"""Sketches of word sets and edit distances of many pairs at a time, in arrays of numbers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import ALPHA, BETA, distance, trimmed

#: Bytes of text that are gone through at a time.
CHUNK = 1 << 22
WORD = np.zeros(256, bool)
WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts in UTF-8, one after the other in data, and where each text's begin and end among them."""
    word = WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    at = np.flatnonzero(first)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    signs, places = data[word].astype(np.uint64), np.flatnonzero(first[word])
    lengths = np.diff(np.append(places, len(signs)))
    inside = np.arange(len(signs)) - np.repeat(places, lengths)
    keys = mixed(np.arange(1, lengths.max() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return mixed(np.add.reduceat((signs + np.uint64(1)) * keys[inside], places)), bounds


def sketches(data: np.ndarray, offsets: np.ndarray, longs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text's set has, and the bytes of all sketches: of longs numbers of 64 bits, a power of two of them, each word flips one bit."""
    counts, found, start = np.zeros(len(longs), np.int32), [], 0
    while start < len(longs):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1)
        low = offsets[start]
        numbers, bounds = word_numbers(data[low : offsets[end]], offsets[start : end + 1] - low)
        places, at = [np.zeros(0, np.int64)], 0
        for k in range(end - start):
            own = np.sort(numbers[bounds[k] : bounds[k + 1]])
            own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
            counts[start + k], bits = len(own), 64 * int(longs[start + k])
            places.append((own & np.uint64(bits - 1)).astype(np.int64) + at)
            at += bits
        flips = np.bincount(np.concatenate(places), minlength=at) & 1
        found.append(np.packbits(flips.astype(np.uint8), bitorder="little"))
        start = end
    return counts, np.concatenate(found) if found else np.zeros(0, np.uint8)


def close_pairs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, least: float, within: bool, eps: float = 1e-9) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y (sketches, a row each; n and m words) whose sets may have the Jaccard similarity least: bits that differ are words that
    aren't shared, at least. within: y is x, and each pair is given once. Some pairs at a time."""
    order, other = np.argsort(n, kind="stable"), np.argsort(m, kind="stable")
    x, n, y, m = x[order], n[order].astype(np.int64), np.ascontiguousarray(y[other].T), m[other].astype(np.int64)
    high, wide = 32, 1024
    # bits that differ * (1 + least) <= (1 - least) * (n + m)
    share = (1 - least) / (1 + least) if least > -1 else np.inf
    for i in range(0, len(n), high):
        some, ns = x[i : i + high], n[i : i + high]
        low, top = 0, len(m)
        if least > 0:
            low, top = int(np.searchsorted(m, np.ceil(least * ns[0] - eps))), int(np.searchsorted(m, np.floor((ns[-1] + eps) / least), "right"))
        for j in range(max(low, i if within else 0), top, wide):
            ms = m[j : min(j + wide, top)]
            both = ns[:, None] + ms[None, :]
            unlike = np.zeros(both.shape, np.int32)
            for k in range(len(y)):
                unlike += np.bitwise_count(some[:, k, None] ^ y[k, None, j : j + len(ms)])
            good = unlike <= share * both + eps if least > -1 else np.ones(both.shape, bool)
            a, b = np.nonzero(good)
            a, b = a + i, b + j
            good = np.minimum(n[a], m[b]) >= least * np.maximum(n[a], m[b]) - eps
            if within:
                good &= a < b
            if good.any():
                yield order[a[good]], other[b[good]]


class Text:
    """A text in UTF-8. Its words and its letters are made when they are asked for, once."""

    __slots__ = ("_letters", "_words", "body")

    def __init__(self, body: bytes):
        self.body, self._words, self._letters = body, None, None

    @property
    def words(self) -> frozenset[bytes]:
        if self._words is None:
            self._words = frozenset(re.findall(rb"[A-Za-z0-9_]+", self.body))
        return self._words

    @property
    def letters(self) -> str:
        if self._letters is None:
            self._letters = self.body.decode("utf-8", "surrogateescape")
        return self._letters


def valued(pairs: list[tuple[str, str, Text, Text]], least: float, threshold: float | None, eps: float) -> tuple[list[pa.Array], list[str]]:
    """Columns file1, file2, value and their names: the words' Jaccard similarity of the pairs in which it is least or more; given a threshold, the combined similarity of
    those that reach it, as text.combined has it."""
    found, near = [], []
    for file1, file2, x, y in pairs:
        common = len(x.words & y.words)
        union = len(x.words) + len(y.words) - common
        words = common / union if union else 1.0
        if words < least:
            continue
        if threshold is None:
            found.append((file1, file2, words))
            continue
        n, m = len(x.letters), len(y.letters)
        room = math.floor(max(n, m) * (1 - (threshold - BETA * words) / ALPHA) + eps)
        if abs(n - m) <= room or max(n, m) == 0:
            near.append((file1, file2, words, max(n, m), (x.letters, y.letters, room)))
    for (file1, file2, words, longest, _), d in zip(near, distances([x[-1] for x in near]), strict=True):
        if d is not None:
            value = max(0.0, min(1.0, ALPHA * (1 - d / longest if longest else 1.0) + BETA * words))
            if value >= threshold - eps:
                found.append((file1, file2, value))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["file1", "file2", "value"]


#: Pairs that are worked on at a time, and how many letters of them and numbers of their tables; below FEW pairs Python's long integers do.
PAIRS, LETTERS, NUMBERS, FEW = 1024, 1 << 21, 1 << 22, 12


def distances(pairs: list[tuple[str, str, int]]) -> list[int | None]:
    """As distance, for each (a, b, room)."""
    found: list[int | None] = [None] * len(pairs)
    waiting: dict[int, list] = {}
    for i, (a, b, room) in enumerate(pairs):
        a, b = trimmed(a, b)
        room = min(room, len(b))
        if len(b) - len(a) > room:
            continue
        if not a:
            found[i] = len(b)
            continue
        wide = 1 + max(2 * (len(b) - len(a)), min(room, len(b) // 16)) // 64
        waiting.setdefault(wide, []).append((i, a, b, room))
    while waiting:
        wide = min(waiting)
        some = sorted(waiting.pop(wide), key=lambda x: -len(x[2]))
        while some:
            words = len(some[0][2]) // 64 + wide + 2
            size = max(1, min(PAIRS, LETTERS // len(some[0][2])))
            signs = len(set().union(*(x[1] for x in some[:size]))) + 1
            size = max(1, min(size, NUMBERS // (signs * words)))
            least = len(some[0][2]) * 3 // 4
            size = next((k for k, x in enumerate(some[:size]) if len(x[2]) < least), size)
            batch, some = some[:size], some[size:]
            if len(batch) < FEW:
                for i, a, b, room in batch:
                    found[i] = distance(a, b, room, 64 * wide)
                continue
            for (i, a, b, room), (score, bound) in zip(batch, banded_batch(batch, wide), strict=True):
                if score <= bound:
                    found[i] = score if score <= room else None
                elif bound < room:
                    waiting.setdefault(2 * wide, []).append((i, a, b, room))
    return found


def banded_batch(batch: list, wide: int) -> list[tuple[int, int]]:
    """A score of each of the pairs (any, a, b, any), longest b first, and a bound: a score up to it is the distance, else the distance is above
    it. The algorithm of text.banded, with the same band of 64 * wide rows in arrays of wide numbers a pair. The band has hi rows
    below the diagonal that begins at the table's first corner and as many, or one more, above that which ends in its last. The score is
    counted along the latter."""
    count, one = len(batch), np.uint64(1)
    rows = np.array([len(x[1]) for x in batch])
    columns = np.array([len(x[2]) for x in batch])
    more_columns = columns - rows
    hi = (64 * wide - 1 - more_columns) // 2
    lo = 64 * wide - 1 - hi
    words = int(columns[0]) // 64 + wide + 2
    a, b = (np.frombuffer("".join(x[k] for x in batch).encode("utf-32-le", "surrogatepass"), np.uint32) for k in (1, 2))
    numbers = np.zeros(max(int(a.max()), int(b.max())) + 1, np.int64)
    numbers[a] = 1
    signs = int(numbers.sum()) + 1
    numbers = np.where(numbers == 1, np.cumsum(numbers) - 1, signs - 1)
    a, b = numbers[a], numbers[b]
    # Of each pair and sign, the rows of a that have it, moved so that in column c the band begins at bit c.
    table = np.zeros((words, count * signs), np.uint64)
    pair = np.repeat(np.arange(count), rows)
    bit = np.arange(len(a)) - np.repeat(np.cumsum(rows) - rows, rows) + lo[pair]
    np.add.at(table.reshape(-1), (bit >> 6) * (count * signs) + a * count + pair, one << (bit & 63).astype(np.uint64))
    pair = np.repeat(np.arange(count), columns)
    begins = np.zeros((int(columns[0]), count), np.int64)
    begins[np.arange(len(b)) - np.repeat(np.cumsum(columns) - columns, columns), pair] = b * count + pair
    first = np.arange(wide)[:, None] * 64
    up = np.where(first >= lo, ~np.uint64(0), np.where(first + 64 <= lo, np.uint64(0), ~np.uint64(0) << np.clip(lo - first, 0, 63).astype(np.uint64)))
    down = np.zeros_like(up)
    end = lo - more_columns
    where, shift = (end >> 6) * count + np.arange(count), (end & 63).astype(np.uint64)
    score = np.zeros(count, np.uint64)
    active = np.searchsorted(-columns, -np.arange(int(columns[0])), "left").tolist()
    rows_of, carries = np.empty((wide + 1, count), np.uint64), np.zeros((wide - 1, count), bool)
    carried = np.zeros((wide - 1, count), np.uint64)
    same, sums, other, diagonal = (np.empty_like(up) for _ in range(4))
    low, high, s1, g0, g1, o0 = rows_of[:-1], rows_of[1:], sums[1:], diagonal[:-1], diagonal[1:], other[:-1]
    flat, top = diagonal.reshape(-1), np.uint64(63)
    for c in range(int(columns[0])):
        table[c >> 6 : (c >> 6) + wide + 1].take(begins[c], 1, rows_of, "clip")
        r = c & 63
        if r:
            np.right_shift(low, np.uint64(r), same)
            np.left_shift(high, np.uint64(64 - r), other)
            np.bitwise_or(same, other, same)
        else:
            same[:] = low
        np.bitwise_and(same, up, other)
        np.add(other, up, sums)
        if wide > 1:
            # A number carries if its highest bit is set in both, or in up and not in the sum. A carry seldom goes on beyond the next number.
            np.invert(sums, diagonal)
            np.bitwise_and(diagonal, up, diagonal)
            np.bitwise_or(diagonal, other, diagonal)
            np.right_shift(g0, top, carried)
            np.add(s1, carried, s1)
            np.less(s1, carried, carries)
            while carries.any():
                carried[:] = 0
                carried[1:] = carries[:-1]
                np.add(s1, carried, s1)
                np.less(s1, carried, carries)
        np.bitwise_xor(sums, up, diagonal)
        np.bitwise_or(diagonal, same, diagonal)
        np.bitwise_or(diagonal, down, diagonal)
        n = active[c]
        score[:n] += (flat.take(where[:n]) >> shift[:n]) & one
        np.bitwise_or(diagonal, up, sums)
        np.invert(sums, sums)
        np.bitwise_or(sums, down, sums)
        np.bitwise_and(diagonal, up, up)
        if wide > 1:
            np.left_shift(g1, top, o0)
        np.right_shift(diagonal, one, diagonal)
        if wide > 1:
            np.bitwise_or(g0, o0, g0)
        np.bitwise_or(diagonal, sums, other)
        np.invert(other, other)
        np.bitwise_or(up, other, up)
        np.bitwise_and(diagonal, sums, down)
    score = columns - score.astype(np.int64)
    return list(zip(score.tolist(), (more_columns + 2 * hi + 1).tolist(), strict=True))
