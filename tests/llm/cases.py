"""Small tables with nulls, empty and very long texts, ties, repeated rows and names that clash."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}x" for _ in range(n))


def rows():
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:50] + ["changed"] + words[51:])
    out = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, prose(2, 150), "en", "a", 1), (5, None, "en", None, None), (6, None, None, "a", None),
        (7, "", "en", "a", 0), (8, "", "fr", "b", 0), (9, "123 456 !!", "en", "a", 1), (10, prose(3, 60_000, 5000), "en", "a", 1), (11, "one two", "en", "a", 1), (12, "one two", "en", "c", 1),
        (13, "same line\nsame line\n\nother words here now\nsame line", "en", "a", 1), (14, "a b c d e f g h i j\na b c d e f g h i k\nunique words stand here", "en", "a", 1),
        (15, "x" * 100_000, "en", "c", 1), (None, prose(4, 80), "en", "c", 1), (16, prose(5, 90), "en", "a", 1), (16, prose(5, 90), "en", "a", 1), (17, "\t\n \n", "en", "a", 1),
    ]
    return out


def documents(spark, extra: bool = False):
    d = spark.createDataFrame(rows(), DOC)
    if extra:
        from pyspark.sql import functions as F

        for name in ("kept", "n_words", "shard", "found", "key", "label", "text_key", "epoch", "line_no", "sketch", "title"):
            d = d.withColumn(name, F.lit("clash"))
    return d


def empty(spark):
    return spark.createDataFrame([], DOC)
