import hashlib
import random
import re

import cases

from siltworks.llm.decontam import Automaton, contamination, cut_runs, decontaminate, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = lower(text), set(), set()
    for name, item in items:
        w = lower(item)
        n = min(13, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(name)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def fixture():
    rng = random.Random(6)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30) if i % 3 else rng.randint(9, 12)))) for i in range(8)] + [(20, None), (21, "!!"), (22, "Zürich-Öl x"), (23, "a a a a a a a a a a a a a a a a")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"{rng.choice('AB')} {items[k][1].upper()}, {texts[k]}" for k in range(8)] + ["Zürich.öl X", "zÜrich Öl x" * 3, "a " * 40, None, "", "..."]
    return items, texts


def test_equals_brute_force(spark):
    items, texts = fixture()
    items = [x for x in items if x[1] is None or len(x[1].split()) > 5 or x[0] > 20]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert {r.doc_id: tuple(r)[1:] for r in contamination(d, b).collect()} == want


def test_blocks_give_the_same(spark):
    from siltworks.llm import decontam

    items, texts = fixture()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = decontam.hit_spans(d, b, "f").select("doc_id", "f").orderBy("doc_id").collect()
    many = decontam.hit_spans(d, b, "f", block_words=30).select("doc_id", "f").orderBy("doc_id").collect()
    assert one == many


def test_automaton_finds_all_substrings():
    rng = random.Random(8)
    for _ in range(60):
        items = {i: [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 12))] for i in range(4)}
        parts = {tuple(w[i:j]) for w in items.values() for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        automaton, state, n = Automaton(items, 3), 0, 0
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        for i, w in enumerate(text, 1):
            state, n = automaton.move(state, n, w)
            assert n == max((k for k in range(i + 1) if not k or tuple(text[i - k : i]) in parts))


def test_odd_rows(spark):
    d = cases.documents(spark, extra=True)
    passage = " ".join(cases.prose(2, 150).split()[20:60])
    b = spark.createDataFrame([(1, passage, 0), (1, passage, 0), (None, "one two", 1), (2, None, 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in contamination(d, b).collect()}
    assert got[4].n_hit == 40 and got[4].n_items == 1 and got[4].contaminated and got[5].n_words == 0 and not got[11].contaminated
    left = decontaminate(d, b)
    assert left.columns == d.columns and left.count() == len(cases.rows()) - 1
    assert decontaminate(d, b, coverage=1, cut=13).where("doc_id = 4").first().text.split() == cases.prose(2, 150).split()[:20] + cases.prose(2, 150).split()[60:]
    assert contamination(cases.empty(spark), b).count() == 0 and contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert cut_runs("A b, c d.", [1, 3], 1) == "A  d." and words_of("É-a") == ["É".encode(), b"a"]
