import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import audio, bits, color, paths, sketch, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("a", "", 0.0), ("日本", "中国", 0.4), ("a b c", "a b d", 0.6 * 0.8 + 0.4 * 0.5)])
def test_text_similarity(spark, a, b, want):
    assert one(spark, text.text_similarity(F.lit(a), F.lit(b)))[0] == pytest.approx(want)


def test_text_normalise_and_words(spark):
    assert one(spark, text.normalise(F.lit("　a \t b﻿\n")))[0] == "a b"
    assert one(spark, text.word_set(F.lit("a中b a_1 A"))) == (["a", "b", "a_1", "A"],)


@pytest.mark.parametrize("x", ["a中b a_1 A", "", "...", "é٣_x\u00a0Z9 ſ K\U0001f600q", "a a A"])
def test_word_hashes_are_of_the_word_set(spark, x):
    got, want = one(spark, text.word_hashes(F.lit(x)), F.transform(text.word_set(F.lit(x)), lambda w: F.xxhash64(w)))
    assert got == want


@pytest.mark.parametrize("path, ext, name", [("/a/x.TXT", ".txt", "x.TXT"), ("/a/.gitignore", "(no extension)", ".gitignore"), ("/a.b/c", "(no extension)", "c"), ("/a/b.tar.gz", ".gz", "b.tar.gz"), ("/a/b.", ".", "b.")])
def test_paths(spark, path, ext, name):
    assert one(spark, paths.extension(F.lit(path)), paths.basename(F.lit(path))) == (ext, name)


def test_depth_and_kind(spark):
    assert one(spark, paths.depth(F.lit("/r/a/b/c.txt"), F.lit("/r")), paths.depth(F.lit("/r/c.txt"), F.lit("/r"))) == (2, 0)
    assert one(spark, *(paths.media_type(F.lit(e)) for e in (".md", ".png", ".mp4", ".mp3", ".bin"))) == ("text", "image", "video", "audio", "other")


@pytest.mark.parametrize("n, want", [(0, "0 B"), (91, "91 B"), (100, "100 B"), (1024, "1 KB"), (1536, "1.5 KB"), (29881, "29.18 KB"), (16861413, "16.08 MB"), (2**50, "1 PB"), (2**61, "2048 PB")])
def test_format_bytes(spark, n, want):
    assert one(spark, paths.format_bytes(F.lit(n)))[0] == want == paths.format_bytes_py(n)


def test_bits(spark):
    assert one(spark, bits.hamming(F.lit("0101"), F.lit("0011")))[0] == 2
    a, b = F.lit("v1:1:0101:x"), F.lit("v1:2:01010101:y")
    assert one(spark, bits.fingerprint_distance(a, b), bits.fingerprint_similarity(a, b)) == (4, 0.5)
    assert one(spark, bits.fingerprint_similarity(F.lit("a1:64::x"), b))[0] == 0.0
    grid = F.array(*(F.lit(float(i % 9)) for i in range(72)))
    assert one(spark, bits.difference_hash(grid))[0] == "1" * 64
    assert one(spark, bits.average_hash(F.array(*map(F.lit, (1.0, 2.0, 3.0, 2.0)))))[0] == "0111"
    long = "01" * 32
    assert one(spark, bits.packed_hamming(bits.packed(F.lit(long)), bits.packed(F.lit("1" * 64))))[0] == 32


def test_frame_schedule(spark):
    for seconds, want in ((0.5, [0.25]), (4.0, [4 / 3, 8 / 3]), (60.0, [10, 20, 30, 40, 50])):
        assert one(spark, bits.frame_schedule(F.lit(seconds)))[0] == pytest.approx(want)


def test_colour(spark):
    def sign(r, g, b, v):
        return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip((r, g, b, v), ("r", "g", "b", "variance"))))

    a, b = sign(120, 140, 210, 0), sign(100, 200, 100, 0)
    assert one(spark, color.color_distance(a, b))[0] == pytest.approx(0.2873, abs=1e-4)
    assert one(spark, color.image_similarity(F.lit(0), a, b))[0] == pytest.approx(0.7127, abs=1e-4)
    assert one(spark, color.image_similarity(F.lit(0), sign(120, 140, 210, 0.3), sign(100, 200, 100, 0.3)))[0] == pytest.approx(0.7702, abs=1e-4)
    c, d = sign(100, 100, 100, 0.03), sign(100, 100, 100, 0.3)
    assert one(spark, color.image_similarity(F.lit(32), c, d))[0] < 0.6


def test_audio(spark):
    silence = spark.createDataFrame([([0] * 4096,), ([1] * 511,), (None,), ([3] * 600,)], "s array<smallint>").select(audio.audio_fingerprint("s").alias("f")).collect()
    assert silence[0].f.startswith("a1:64:1" + "0" * 64 + ":") and silence[1].f is None and silence[2].f is None and silence[3].f.startswith("a1:64::")
    samples = [(i * 37) % 101 - 50 for i in range(1024)]
    want = audio.sample_bits(samples)
    assert float(int(one(spark, audio.window_bits(F.array(*map(F.lit, samples))))[0], 2)) == float(int(want, 2))


def test_edit_distance(spark):
    import random

    rng = random.Random(11)
    pairs = [("".join(rng.choice("abé中😀") for _ in range(rng.randint(0, 90))), "".join(rng.choice("abé中😀") for _ in range(rng.randint(0, 90)))) for _ in range(200)]
    pairs += [(a, a[:7] + "x" + a[9:]) for a, _ in pairs]
    d = spark.createDataFrame(pairs, "a string, b string")
    assert [r.w for r in d.select(F.levenshtein("a", "b").alias("w")).collect()] == [text.distance(a, b) for a, b in pairs]
    assert d.select(text.edit_distance("a", "b", F.lit(1_000_000)).alias("w")).agg(F.sum("w")).first()[0] == sum(text.distance(a, b) for a, b in pairs)


def test_distance_in_bands_is_that_of_the_whole_table():
    import random

    from siltworks.functions.text import distance

    def plain(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            before = row
        return before[-1]

    rng = random.Random(1)
    for n in [rng.randint(0, 50) for _ in range(400)] + [1500, 1300]:
        a = "".join(rng.choice("abcd") for _ in range(n))
        b = list(a)
        for _ in range(rng.choice((2, 10, 60))):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(("", "x", "ab"))
        b = "".join(b)
        want, room = plain(a, b), rng.randint(0, 60)
        assert distance(a, b) == distance(b, a) == want and distance(a, b, room) == (want if want <= room else None)


def test_distances_of_many_pairs(monkeypatch):
    """Pairs worked on together have the distances that they have one by one, with any room; a letter beyond those of the other text too."""
    monkeypatch.setattr(sketch, "FEW", 1)
    rng, pairs = random.Random(7), []
    for k in range(240):
        letters = ("ab", "abcdefgh é日")[k % 2]
        a = [rng.choice(letters) for _ in range(rng.choice((0, 5, 70, 200, 500)))]
        b = list(a) if k % 3 else [rng.choice(letters) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 1 + len(b) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ba"])
        pairs.append(("".join(a), "".join(b)))
    for room in (0, 3, 60, 1000):
        assert sketch.distances([(a, b, room) for a, b in pairs]) == [text.distance(a, b, room) for a, b in pairs]


def test_sketches_have_each_word_of_a_text_once(monkeypatch):
    monkeypatch.setattr(sketch, "CHUNK", 64)
    texts = ["", "a b a", "é", "b", "word1 word_2 " * 30, "a" * 100, "b a"]
    body = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in body]))
    n, flips = sketch.sketches(np.frombuffer(b"".join(body), np.uint8), offsets, np.full(len(body), 8))
    rows = flips.view(np.uint64).reshape(len(body), 8)
    assert n.tolist() == [len(sketch.Text(b).words) for b in body] == [0, 2, 0, 1, 2, 1, 2]
    assert np.bitwise_count(rows).sum(1).tolist() == n.tolist() and (rows[1] == rows[6]).all() and not (rows[3] == rows[5]).all()
