import base64
import random
import re

import cases

from siltworks.llm.compression import Bands, compression_quality, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    hit = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", "é", "\n", " ", "\t", "\x0b", "\x1c", "\u00a0", "#", "*", "<"]) for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "\n\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in compression_quality(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_verdicts(spark):
    noise = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 7] for i in range(0, len(noise), 7))
    parts = [cases.prose(9, 700, 3000), "spam eggs " * 900, noise, cases.prose(10, 3000, 3000) + " " + "".join(f"{i % 10} " for i in range(9000))]
    d = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in compression_quality(d).collect()}
    assert got[0] and not got[1] and not got[3]
    tight = Bands(low=(1.6,) * 8)
    assert not {r.doc_id: r.kept for r in compression_quality(d, tight).collect()}[2]


def test_tails_and_short_texts_are_judged(spark):
    rng = random.Random(2)
    clean = (cases.prose(11, 3000, 3000) * 2).encode()[:12_000].decode()
    texts = [clean[:n] + " " + base64.b64encode(rng.randbytes(4000)).decode()[:k] for n, k in ((4095, 1500), (4095, 2500), (4095, 4000), (1500, 1200))] + [clean[:5600], clean[:2700], clean[:900]]
    got = {r.doc_id: r for r in compression_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(len(texts))] == [False] * 4 + [True] * 3
    assert [got[i].n_chunks for i in (4, 5, 6)] == [6, 3, 1]


def test_odd_rows(spark):
    d = compression_quality(cases.documents(spark, extra=True)).collect()
    assert len(d) == len(cases.rows())
    by = {r.doc_id: r for r in d}
    assert by[5].base_failed and not by[5].kept and by[5].n_words == 0 and by[7].ratio == 0
    assert by[10].n_words == 60_000
    assert compression_quality(cases.empty(spark)).count() == 0
    assert repeated_words([b"a"] * 5) == 5


def test_the_corpus_has_bands_of_its_own(spark):
    """Symbols within otherwise clean prose are no case for the bands that hold everywhere, but far from the corpus."""
    rng = random.Random(5)
    clean = [cases.prose(200 + i, 400 + i % 40, 3000) for i in range(300)]
    odd = [" ".join(w + rng.choice(["***", "%%%", "$$$", "&&&"]) for w in x.split()[:250]) for x in clean[:8]]
    d = spark.createDataFrame(list(enumerate(clean + odd)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in compression_quality(d).collect()}
    assert all(r.within and not r.base_failed for r in got.values())
    assert [got[i].kept for i in range(308)] == [True] * 300 + [False] * 8
    few = compression_quality(d.where("doc_id >= 250")).collect()
    assert all(r.kept for r in few)  # fewer than `least` have no bands of their own
    assert all(r.kept for r in compression_quality(d, Bands(spread=1000)).collect())


def test_documents_rejected_are_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [r for r in compression_quality(d).collect() if not r.base_failed]
    gone = [r for r in got if not r.kept]
    assert 100 < len(gone) < 0.05 * len(got) and sum(5 * r.n_symbols >= r.n_words for r in gone) > 0.95 * len(gone)
