import random

import cases
import numpy as np

from siltworks.llm.dart_minhash import near_duplicates, odd_sketch, signatures, similarity, weighted, without_near_duplicates


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def fixture():
    rng = random.Random(7)
    out = [(i, cases.prose(100 + i, rng.randint(30, 120), 3000)) for i in range(40)]
    base = cases.prose(1, 160, 3000).split()
    out += [(1000 + i, edited(base, rng, rng.randint(0, 8))) for i in range(80)]
    return out + [(2000 + i, out[i][1]) for i in range(5)]


def brute(rows):
    sets, parent = [weighted(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and (rows[i][1] == rows[j][1] or similarity(sets[i], sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_classes_are_those_of_all_pairs(spark):
    rows = fixture()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a = (np.sort(x[:300]), rng.random(300) * 4)
    pick = np.isin(a[0], x[:250])
    b = (np.sort(np.concatenate([a[0][pick], x[300:350]])), None)
    weights = dict(zip(a[0].tolist(), a[1].tolist()))
    b = (b[0], np.array([weights.get(int(e), 1.0) * (1.0 if i % 3 else 0.5) for i, e in enumerate(b[0])]))
    s, t = signatures([a, b], 2048)
    assert abs((s == t).mean() - similarity(a, b)) < 0.05
    assert (signatures([a], 64)[0] == signatures([b, a], 64)[1]).all()
    assert signatures([(x[:0], np.empty(0))], 8) == [None]


def test_sketch_never_overstates():
    rng = random.Random(2)
    for _ in range(50):
        a, b = weighted(cases.prose(rng.random(), 80, 60)), weighted(cases.prose(rng.random(), 80, 60))
        low = similarity(a, b) * (a[1].sum() + b[1].sum()) / (1 + similarity(a, b))
        unlike = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(odd_sketch(*a, 256).view("<u8"), odd_sketch(*b, 256).view("<u8")))
        assert unlike <= a[1].sum() + b[1].sum() - 2 * low + 1e-6


def test_odd_rows(spark):
    got = near_duplicates(cases.documents(spark)).collect()
    assert len(got) == len(cases.rows())
    by = {r.doc_id: r for r in got}
    assert [by[i].class_id for i in (1, 2, 3, 5, 6, 7, 8, 11, 12)] == [1, 1, 1, 5, 6, 7, 7, 11, 11] and by[16].n_copies == 2
    assert near_duplicates(cases.empty(spark)).count() == 0
    left = without_near_duplicates(cases.documents(spark, extra=True))
    assert left.columns == cases.documents(spark, extra=True).columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 13, 14, 15, 16, 17] and ids.count(None) == 1
