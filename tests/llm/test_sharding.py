import zlib
from collections import Counter, defaultdict

import cases
import numpy as np

from siltworks.llm.sharding import assign_shards, pack, write_shards


def test_law_and_slots(spark):
    rows = [(i, cases.prose(i % 900, 20 + i % 70)) for i in range(3000)] + [(5000 + i, "hot text " * 20) for i in range(1500)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    sizes, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[texts[r.doc_id]].add(r.shard)
    assert len(sizes) == 16 and max(sizes.values()) < 1.02 * sum(sizes.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in groups.items() if not t.startswith("hot"))


def test_pack_takes_the_best_dot_product():
    sizes = np.array([[0.3, 0.1, 0.1], [0.1, 0.3, 0.1], [0.1, 0.1, 0.3], [0.2, 0.2, 0.2]])
    bins = pack(sizes, 2)
    assert len(set(bins)) == 2
    many = np.random.default_rng(1).dirichlet(np.ones(3000), 3).T
    load = np.array([many[pack(many, 16) == k].sum(axis=0) for k in range(16)])
    assert abs(load[:, 0] * 16 - 1).max() < 0.01 and abs(load * 16 - 1).max() < 0.05


def test_groups_that_fit_in_a_shard_stay_whole(spark):
    copies = {f"group {g} " * (5 + g): 20 + 12 * g for g in range(12)}
    texts = [t for t, n in copies.items() for _ in range(n)] + [cases.prose(i, 20 + i % 70) for i in range(2500)] + ["hot text " * 20] * 900
    got = assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes, groups = Counter(), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        groups[texts[r.doc_id]].add(r.shard)
    assert len(got) == len(texts) and max(sizes.values()) < 1.02 * sum(sizes.values()) / 16
    assert all(len(groups[t]) == 1 for t in copies) and len(groups["hot text " * 20]) > 1


def test_pack_cuts_what_fits_in_no_bin():
    groups = np.repeat(np.arange(5), 100)
    bins = pack(np.full((500, 3), 1 / 500), 4, groups)
    assert np.bincount(bins).tolist() == [125] * 4 and sorted(len(set(bins[groups == g])) for g in range(5)) == [1, 1, 1, 1, 4]


def test_odd_rows(spark, tmp_path):
    d = cases.documents(spark, extra=True)
    got = assign_shards(d).collect()
    assert len(got) == len(cases.rows()) and {r.size for r in got if r.doc_id in (5, 6, 7)} == {1} and {r.text_crc32 for r in got if r.doc_id in (5, 7)} == {0}
    assert assign_shards(cases.empty(spark)).count() == 0
    write_shards(d, f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(cases.rows())


def test_documents_that_fit_stay_together(spark):
    for sf in ("0.01", "0.1"):
        d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        text = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
        sizes, groups = Counter(), defaultdict(set)
        for r in assign_shards(d).collect():
            sizes[r.shard] += r.size
            groups[text[r.doc_id] or ""].add(r.shard)
        assert all(len(g) == 1 for g in groups.values())
        assert len(sizes) == 16 and max(sizes.values()) < 1.01 * sum(sizes.values()) / 16 and min(sizes.values()) > 0.99 * sum(sizes.values()) / 16
