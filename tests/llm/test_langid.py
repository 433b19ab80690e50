import zlib
from itertools import combinations

import cases
import numpy as np
from pyspark.sql import functions as F

from siltworks.llm.langid import MAX_N, UNKNOWN, cells, language_mixture, learn, with_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_mixture(d).join(d.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.true).mean() > 0.97 and got.score.between(0, 1).all()


def test_mixture_is_found(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(d)
    en, de = (d.where((F.col("lang") == x) & (F.length("text") > 3000)).first().text[:3000] for x in ("en", "de"))
    lang, score, langs, shares = model.predict(en + " " + de[:1500])
    assert lang == "en" and set(langs) == {"en", "de"} and 0.5 < score < 0.85
    assert model.predict(en)[2] == ["en"]


def test_odd_rows(spark):
    d = cases.documents(spark, extra=True)
    got = {r.doc_id: r for r in language_mixture(d).collect()}
    assert [got[i].lang_pred for i in (5, 7, 9, 17)] == [UNKNOWN] * 4 and got[9].score == 0
    left = with_language(d)
    assert left.columns == d.columns and not {5, 6, 7, 8, 9, 17} & {r.doc_id for r in left.collect()}
    assert language_mixture(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in language_mixture(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {UNKNOWN}


def brute_shares(p, n, rounds=4000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        joint = p * share
        share = (joint / joint.sum(axis=1)[:, None] * n[:, None]).sum(axis=0) / n.sum()
    return share, float(n @ np.log(p @ share))


def test_set_is_the_best_by_penalised_likelihood(spark):
    """Against all subsets, with shares by many rounds of plain expectation-maximisation."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(d)
    texts = {x: " ".join(r.text for r in d.where(F.col("lang") == x).limit(40).collect()) for x in model.langs}
    for sizes in ({"en": 4000, "de": 60}, {"en": 3000, "fr": 900, "es": 300}, {"es": 500}, {"de": 2000, "fr": 2000}, {"en": 60_000, "de": 900}):
        text = " ".join(texts[k][:n] for k, n in sizes.items())
        c, n = cells(text)
        cost = MAX_N * np.log(n.sum()) / 2
        best = max((brute_shares(model.p[c][:, list(s)], n)[1] - cost * len(s), s) for k in range(1, 5) for s in combinations(range(len(model.langs)), k))[1]
        _, score, langs, shares = model.predict(text)
        assert set(langs) == {model.langs[k] for k in best}, sizes
        want = brute_shares(model.p[c][:, [model.langs.index(x) for x in langs]], n)[0]
        assert np.abs(np.array(shares) - want).max() < 0.02 and score == shares[0]


def test_numerals_are_no_letters(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(d)
    assert [model.predict(x)[0] for x in ("½ ² Ⅷ ①", "²", "12 _ 3", "", None)] == [UNKNOWN] * 5
    assert model.predict("½ a")[0] in model.langs


def test_stage_drops_what_is_in_no_one_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [d.where(F.col("lang") == x).orderBy(F.desc("n_chars")).first().text[:2000] for x in ("en", "de", "fr")]
    some = spark.createDataFrame([(1, parts[0]), (2, " ".join(parts)), (None, parts[1]), (2, " ".join(parts))], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in with_language(some, learn(d)).collect()) == [0, 1]
    assert with_language(cases.empty(spark)).count() == 0
