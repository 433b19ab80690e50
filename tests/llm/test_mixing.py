from collections import Counter, defaultdict

import cases

from siltworks.llm.mixing import Target, bisect, exponent, mixed, temperature_mix


def corpus(spark):
    rows = [(i, cases.prose(i, 10 + i % 30), "en", "big" if i % 3 else f"s{i % 7}", 1) for i in range(1500)]
    return spark.createDataFrame(rows, cases.DOC), rows


def test_budgets(spark):
    d, rows = corpus(spark)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    got = temperature_mix(d).collect()
    taken, times = defaultdict(int), Counter((r.doc_id, r.epoch) for r in got)
    assert max(times.values()) == 1
    for r in got:
        taken[r.source] += r.n_tokens
    per = Counter(r.doc_id for r in got)
    assert min(per[r[0]] for r in rows) == 1 and max(per.values()) <= 2
    most = max(tokens, key=tokens.get)
    assert taken[most] == tokens[most]
    sources = spark.createDataFrame([(s, t) for s, t in tokens.items()], "source string, tokens long")
    a, z, budget = exponent(sources, Target())
    total = sum(tokens.values())
    for s, t in tokens.items():
        assert abs(taken[s] - (t / total) ** a / z * budget) <= 60
    assert max(taken[s] / tokens[s] for s in tokens) <= 2.05


def test_prefix_of_the_key_holds_the_weights(spark):
    d, _ = corpus(spark)
    got = temperature_mix(d).collect()
    full, half = Counter(), Counter()
    for r in got:
        full[r.source] += r.n_tokens
        half[r.source] += r.n_tokens * (r.mix_key < 0.5)
    assert all(abs(half[s] / full[s] - 0.5) < 0.2 for s in full)


def test_entropy_and_budget(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a, z, budget = exponent(sources, Target(repetition=1e9, entropy=0.9))
    p = [(t / 1110) ** a / z for t in (1000, 100, 10)]
    import math

    assert abs(-sum(x * math.log(x) for x in p) / math.log(3) - 0.9) < 1e-6
    assert abs(exponent(sources, Target(repetition=1.0))[0] - 1.0) < 1e-6
    assert abs(bisect(lambda x: x >= 0.25) - 0.25) < 1e-9
    d, rows = corpus(spark)
    small = temperature_mix(d, Target(budget=3000.0)).collect()
    assert abs(sum(r.n_tokens for r in small) - 3000) < 8 * 45


def test_odd_rows(spark):
    d = cases.documents(spark, extra=True)
    left = mixed(d)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {r[0] for r in cases.rows()}
    assert mixed(cases.empty(spark)).count() == 0
