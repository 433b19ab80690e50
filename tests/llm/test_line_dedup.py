import random

import cases
from pyspark.sql import functions as F

from siltworks.llm import line_dedup
from siltworks.llm.line_dedup import line_decisions, without_repeated_lines


def brute(rows):
    lines, out = [], {}
    for doc, text in sorted(rows):
        out[doc] = []
        for i, line in enumerate((text or "").replace("\t", " ").split("\n")):
            words = set(line.split(" ")) - {""}
            if words:
                if any(5 * len(words & w) >= 4 * len(words | w) for w in lines):
                    out[doc].append(i)
                lines.append(words)
    return out


def fixture(n=60):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(40)]
    rows = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.5:
                words = list(base)
                for _ in range(rng.randint(0, 6)):
                    words[rng.randrange(40)] = f"n{rng.randrange(200)}"
                lines.append(" ".join(words))
            elif kind < 0.8:
                lines.append(" ".join(f"q{rng.randrange(60)}" for _ in range(rng.randint(1, 9))))
            else:
                lines.append("a very common line")
        rows.append((doc, "\n".join(lines)))
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    rows = fixture()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r.doc_id: r.removed_lines for r in line_decisions(d).collect()} == want
    monkeypatch.setattr(line_dedup, "HOT", 3)
    assert {r.doc_id: r.removed_lines for r in line_decisions(d).collect()} == want


def test_odd_rows(spark):
    d = cases.documents(spark, extra=True)
    got = {}
    for r in line_decisions(d).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(cases.rows())
    assert got[13][0].removed_lines == [1, 4] and got[14][0].removed_lines == [1] and got[14][0].n_near == 1
    assert got[5][0].n_lines == 0 and got[7][0].removed_lines == [] and got[2][0].n_removed == 1
    assert [r.n_removed for r in got[16]] == [0, 0]
    cut = without_repeated_lines(d)
    assert cut.columns == d.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[13] == "same line\n\nother words here now" and texts[5] is None and texts[2] == ""
    assert line_decisions(cases.empty(spark)).count() == 0


def test_pairs_of_a_large_group_are_not_all_made(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(800)]
    rng.shuffle(rows)
    made, pairs_of = [], line_dedup.pairs_of

    def counted(*args):
        found = pairs_of(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "pairs_of", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.removed_lines for r in line_decisions(d).collect()} == brute(rows)
    assert sum(made) <= 10 * len(rows)


def test_further_candidates_are_tried_without_a_second_join(spark, monkeypatch):
    rows = fixture(120)
    rows += [(1000 - doc, text) for doc, text in rows]
    made, pairs_of = [], line_dedup.pairs_of

    def counted(*args):
        made.append(1)
        return pairs_of(*args)

    monkeypatch.setattr(line_dedup, "pairs_of", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    monkeypatch.setattr(line_dedup, "FEW", 1000, raising=False)
    assert {r.doc_id: r.removed_lines for r in line_decisions(d).collect()} == want
    assert len(made) == 1
    monkeypatch.setattr(line_dedup, "FEW", 1)
    assert {r.doc_id: r.removed_lines for r in line_decisions(d).collect()} == want
    assert len(made) == 3


def test_both_sides_of_the_join_share_a_shuffle(spark):
    names = "word int, place int, id long, n int, sketch long, sketch2 long"
    x = spark.createDataFrame([(1, p, i, n, 0, 0) for i, (p, n) in enumerate([(0, 10), (1, 10), (0, 9), (3, 12)])], names)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = line_dedup.all_pairs(x, line_dedup.Jaccard())
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    every = line_dedup.pairs_of(x, x, F.col("x.id") < F.col("y.id"), line_dedup.Jaccard())
    assert sorted(found.collect()) == sorted(every.collect()) != []
