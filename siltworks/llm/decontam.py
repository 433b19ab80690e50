"""Benchmark decontamination: a generalised suffix automaton of the items' words; documents stream through it
and the longest match at each word tells which words are in occurrences of an item's windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Words of items in one automaton; of more, several automatons pass over the documents one after the other.
BLOCK_WORDS = 100_000
#: Words are runs of ASCII digits, letters and all that isn't ASCII; A-Z are lower-cased, all else ends a word.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items' words. A state is a set of word sequences with the same ends
    in the items; length: of its longest; link: the state of its longest suffix elsewhere; step: by word."""

    def __init__(self, items: dict[int, list[bytes]], window: int = WINDOW):
        self.window, self.step, self.length, self.link = window, [{}], [0], [-1]
        for words in items.values():
            last = 0
            for w in words:
                last = self.extend(last, w)
        # Items by the state where a window ends; the windows of an item are its runs of so many words, or itself.
        self.whole: dict[int, set[int]] = {}
        self.short: dict[tuple[int, int], set[int]] = {}
        for name, words in items.items():
            if 0 < len(words) < window:
                state, n = 0, 0
                for w in words:
                    state, n = self.move(state, n, w)
                self.short.setdefault((state, len(words)), set()).add(name)
            for i, state in enumerate(self.ends(words), 1):
                if i >= window:
                    self.whole.setdefault(self.at(state, window), set()).add(name)
        sizes: dict[int, list[int]] = {}
        for state, n in self.short:
            sizes.setdefault(state, []).append(n)
        # For each state the short items that are suffixes of its longest sequence, longest first.
        self.suffixes: list[tuple] = [()] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            own = tuple((n, state) for n in sorted(sizes.get(state, ()), reverse=True))
            self.suffixes[state] = own + (self.suffixes[self.link[state]] if state else ())
        self.least = min([window] * bool(self.whole) + [n for _, n in self.short], default=0)

    def extend(self, last: int, w: bytes) -> int:
        step, length, link = self.step, self.length, self.link
        if (q := step[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self.split(last, q, w)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, q, w)
        return new

    def split(self, p: int, q: int, w: bytes) -> int:
        step, length, link = self.step, self.length, self.link
        clone = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = clone
            p = link[p]
        return clone

    def move(self, state: int, n: int, w: bytes) -> tuple[int, int]:
        """State and length of the longest match that ends with this word."""
        while state and w not in self.step[state]:
            state = self.link[state]
            n = self.length[state]
        nxt = self.step[state].get(w)
        return (0, 0) if nxt is None else (nxt, n + 1)

    def ends(self, words: list[bytes]):
        state = n = 0
        for w in words:
            state, n = self.move(state, n, w)
            yield state

    def at(self, state: int, n: int) -> int:
        """The state of the last n words of a match that ends in this state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of words within occurrences of windows, as (start, end), and the items that have these."""
        step, link, length, window, least = self.step, self.link, self.length, self.window, self.least
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not least:
            return spans, items
        state = n = 0
        for i, w in enumerate(words, 1):
            nxt = step[state].get(w)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = step[state].get(w)
            if nxt is None:
                n = 0
                continue
            state = nxt
            n += 1
            if n < least:
                continue
            start = i
            if n >= window and self.whole:
                start = i - n
                items |= self.whole[self.at(state, window)]
            for size, found in self.suffixes[state]:
                if size <= n:
                    start = min(start, i - size)
                    items |= self.short[found, size]
            if start < i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automatons(benchmark: DataFrame, window: int, block_words: int):
    """Yields automatons of about block_words words each; the driver holds one. Rows of one item_id with
    different texts are windows of that item. Null and empty items have no windows; a null item_id is left
    out. Items are dealt to blocks by the hash of item_id."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    about = items.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)).first()[0] or 0
    blocks = max(1, -(-int(about) // block_words))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = sorted(part.collect())
        texts = {i: words_of(x.text) for i, x in enumerate(rows)}
        yield Automaton(texts, window), [x.item_id for x in rows]


def hit_spans(docs: DataFrame, benchmark: DataFrame, column: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a column struct<n_words long, spans array<long>, items array<long>>: the number of words, the
    hit runs of words (start and end in turn), and the items, sorted. No shuffle: an automaton has
    block_words words or so (an item isn't cut) and is broadcast; where there are several, docs is written
    between them with what was found."""
    kind = "struct<n_words:bigint,spans:array<bigint>,items:array<bigint>>"
    spark = docs.sparkSession
    out = docs.withColumn(column, F.lit(None).cast(kind))
    for k, (automaton, names) in enumerate(automatons(benchmark, window, block_words)):
        if k:
            out = materialise(out, "decontam")
        shared = spark.sparkContext.broadcast((automaton, names))

        @F.pandas_udf(kind)
        def search(text, before):  # noqa: ANN001

            automaton, names = shared.value
            rows = []
            for x, spans, items in zip(text, before["spans"], before["items"]):
                words = words_of(x)
                found, got = automaton.spans(words)
                if spans is not None and len(spans):
                    found = merged([*zip(spans[::2], spans[1::2]), *found])
                known = set() if items is None else {int(i) for i in items}
                rows.append((len(words), [int(i) for s in found for i in s], sorted(known | {names[i] for i in got})))
            return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

        out = out.withColumn(column, search(F.col("text"), F.col(column)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: int = 20) -> DataFrame:
    """For each row of docs (doc_id, text; null: no words) the words hit, the items found, and whether a
    coverage-th of its words or more is hit."""
    (column,) = fresh(docs, "found")
    x = hit_spans(docs.select("doc_id", "text"), benchmark, column)
    spans, items = F.col(f"{column}.spans"), F.col(f"{column}.items")
    pairs = F.aggregate(F.transform(spans, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0).cast("long"), lambda a, v: a + v)
    listed = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    out = x.select("doc_id", F.col(f"{column}.n_words").alias("n_words"), pairs.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: int = 20, cut: int | None = None) -> DataFrame:
    """docs without the rows of which a coverage-th of the words or more is hit; all columns stay. cut: of the
    rows that stay, hit runs of at least so many words are cut from the text, None: texts stay whole."""
    column, gone = fresh(docs, "found", "hit")
    x = hit_spans(docs, benchmark, column)
    spans = F.col(f"{column}.spans")
    n = F.aggregate(F.transform(spans, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0).cast("long"), lambda a, v: a + v)
    x = x.withColumn(gone, n).where(~((F.col(gone) > 0) & (coverage * F.col(gone) >= F.col(f"{column}.n_words"))))
    if cut is not None:

        @F.pandas_udf("string")
        def without(text, spans):  # noqa: ANN001

            return pd.Series([t if t is None else cut_runs(t, s, cut) for t, s in zip(text, spans)])

        x = x.withColumn("text", without(F.col("text"), spans))
    return x.select(*docs.columns)


def cut_runs(text: str, spans, least: int) -> str:
    """The text without the runs of words (start, end in turn) of at least so many words, blanks between the
    words of a run included."""
    todo = [(int(a), int(b)) for a, b in zip(spans[::2], spans[1::2]) if b - a >= least]
    if not todo:
        return text
    data = text.encode()
    folded, out, at, n, k = data.translate(FOLD), [], 0, 0, 0
    for start, end in word_places(folded):
        if k < len(todo) and n == todo[k][0]:
            out.append(data[at:start])
        n += 1
        if k < len(todo) and n == todo[k][1]:
            at = end
            k += 1
    out.append(data[at:])
    return b"".join(out).decode()


def word_places(folded: bytes):
    at = 0
    for w in folded.split():
        at = folded.index(w, at)
        yield at, at + len(w)
        at += len(w)
