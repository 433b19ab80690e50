"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks, held against
bands that depend on the length. Text that repeats itself compresses too well, noise too badly."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, within boolean, n_bytes long, ratio double, n_chunks long, odd_chunks long"
)
#: Ratios are counted in steps of 1 / STEPS, up to MOST steps, for the corpus's own bands.
STEPS, MOST = 512, 1 << 13
#: Classes of length, two for each power of 2.
CLASSES = 64
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """lengths: upper bounds of the bands in UTF-8 bytes, the last band has none. low, high: the least and
    greatest ratio of raw to compressed bytes in each band. A short text can't compress well nor be judged as
    noise, so the bands widen there. chunk: bytes of a chunk, less than a usual document has. What is left
    after the full chunks is judged too, as the last chunk bytes of the text, and a shorter text is one chunk
    with the band of its length. A document also goes if more than odd_share of its chunks are outside
    chunk_low..chunk_high.

    These bands hold everywhere. Within them the corpus has its own, for each class of length with `least` documents or more that the
    rules above keep: the median ratio of all of these, give or take `spread` times their median deviation from it (scaled to be that of a
    normal distribution), or `margin` of the median if that is more."""

    lengths: tuple[int, ...] = (64, 128, 256, 512, 1024, 4096, 16384)
    low: tuple[float, ...] = (0.0, 0.6, 0.85, 1.05, 1.2, 1.4, 1.5, 1.5)
    high: tuple[float, ...] = (2.5, 2.5, 3.0, 3.2, 3.5, 4.0, 4.5, 5.0)
    chunk: int = 1024
    chunk_low: float = 1.4
    chunk_high: float = 4.0
    odd_share: float = 0.3
    level: int = 3
    spread: float = 6.0
    margin: float = 0.05
    least: int = 100


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hits, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hits += i + 3 - max(end, i)
            end = i + 3
    return hits


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() cuts at the same six
    characters as the rule's words do."""
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, BLANKS)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def verdict(data: bytes, packer, bands: Bands) -> tuple[bool, float, int, int]:
    """Whether it is within the bands that hold everywhere, its ratio, its chunks (every byte is in one), those outside the band."""
    n = len(data)
    ratio = n / len(packer.compress(data))
    k = bisect_left(bands.lengths, n)
    whole = bands.low[k] <= ratio <= bands.high[k]
    if n < bands.chunk:
        return whole, ratio, 1, int(not whole)
    chunks = -(-n // bands.chunk)
    odd = 0
    for i in range(chunks):
        at = min(i * bands.chunk, n - bands.chunk)
        r = bands.chunk / len(packer.compress(data[at : at + bands.chunk]))
        odd += not bands.chunk_low <= r <= bands.chunk_high
    return whole and odd <= bands.odd_share * chunks, ratio, chunks, odd


def length_class():
    return F.floor(2 * F.log2("n_bytes")).cast("int")


def middle(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that occur so often."""
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), (counts.sum() + 1) // 2)])


def corpus_bands(measured: DataFrame, bands: Bands) -> tuple[list[float], list[float]]:
    """The least and the greatest ratio in each class of length, from counts over all documents that are measured and kept so far. The
    driver gets CLASSES * MOST counts at most."""
    step = F.least(F.floor(F.col("ratio") * STEPS), F.lit(MOST - 1)).cast("int").alias("step")
    counts = measured.where("within AND NOT base_failed").groupBy(length_class().alias("k"), step).count().toPandas()
    low, high = [0.0] * CLASSES, [float("inf")] * CLASSES
    for k, part in counts.groupby("k"):
        values, n = (part["step"].to_numpy() + 0.5) / STEPS, part["count"].to_numpy()
        if n.sum() >= bands.least:
            at = middle(values, n)
            room = max(bands.spread * 1.4826 * middle(np.abs(values - at), n), bands.margin * at)
            low[int(k)], high[int(k)] = at - room, at + room
    return low, high


def compression_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """A row per row of docs (doc_id, text): the base counts and rule, kept (by both), within (the bands that hold everywhere), n_bytes, ratio, n_chunks,
    odd_chunks, band_low, band_high; other columns aren't read. Null and empty texts have no words,
    fail the base rule and have ratio 0. Repeated rows give repeated results, and count as often as they occur. Every text is read and compressed once and whole; a
    task holds a batch of texts at most. What is measured is written, a few numbers a document, and counts over
    all of it give the corpus's own bands. No text is shuffled."""
    measured = materialise(measures(docs, bands), "compression")
    low, high = corpus_bands(measured, bands)
    k = F.coalesce(length_class(), F.lit(0))
    out = measured.withColumns({"band_low": F.get(F.array(*map(F.lit, low)), k), "band_high": F.get(F.array(*map(F.lit, high)), k)})
    kept = ~F.col("base_failed") & F.col("within") & F.col("ratio").between(F.col("band_low"), F.col("band_high"))
    return out.select(*out.columns[:7], kept.alias("kept"), *out.columns[7:])


def measures(docs: DataFrame, bands: Bands) -> DataFrame:
    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                data = text.encode()
                base = base_counts(text, data)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                within, ratio, chunks, odd = verdict(data, packer, bands) if data else (False, 0.0, 0, 0)
                rows.append((doc, *base, failed, within, len(data), ratio, chunks, odd))
            cols = list(zip(*rows)) if rows else [[]] * 12
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
