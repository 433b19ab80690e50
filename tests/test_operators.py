import random

import pytest
from pyspark.sql import functions as F

from siltworks.config import CleanupOptions, NearOptions, ScanOptions
from siltworks.functions import bits, text
from siltworks.operators import banding, cleanup, components, exact, incremental, near, stats
from siltworks.plans import catalog
from siltworks.streaming.dedupe import StreamingDedupe

FILE = "path string, name string, size bigint, extension string, mtime bigint, depth int, source_root string, content_hash string"


def files(spark, rows):
    return spark.createDataFrame([(p, p.split("/")[-1], s, "." + p.split(".")[-1], m, p.count("/") - 2, "/" + p.split("/")[1], h) for p, s, m, h in rows], FILE)


ROWS = [("/a/x.txt", 10, 5, "h1"), ("/a/deep/er/copy_x.txt", 10, 9, "h1"), ("/b/x.txt", 10, 5, "h1"), ("/a/e1.md", 0, 1, "h0"), ("/a/e2.md", 0, 2, "h0"), ("/b/u.md", 10, 7, "h2")]


def test_exact_groups(spark):
    f = files(spark, ROWS)
    got = {r.content_hash: r for r in exact.duplicate_hashes(f).collect()}
    assert (got["h1"].n_files, got["h1"].wasted_space, got["h1"].is_cross_directory) == (3, 20, True)
    assert (got["h0"].wasted_space, got["h0"].is_cross_directory) == (0, False) and "h2" not in got
    groups = exact.exact_groups(f).collect()
    assert [g.content_hash for g in groups] == ["h1", "h0"] and [x.path for x in groups[0].files] == ["/a/x.txt", "/b/x.txt", "/a/deep/er/copy_x.txt"]
    assert exact.without_duplicates(f).collect()[0].path == "/b/u.md"
    assert tuple(exact.exact_summary(exact.duplicate_hashes(f.where("false"))).first()) == (0, 0, 0, 0, 0)
    assert {r.size for r in stats.same_size(f).collect()} == {0, 10}


@pytest.mark.parametrize(
    "rule, kept",
    [("mtime_newest", "/a/deep/er/copy_x.txt"), ("mtime_oldest", "/a/x.txt"), ("depth_shallowest", "/a/x.txt"), ("path_shortest", "/a/x.txt"), ("name_pattern", "/a/deep/er/copy_x.txt"), ("prefer_dir", "/b/x.txt"), ("unknown", "/a/deep/er/copy_x.txt")],
)
def test_keep_rules(spark, rule, kept):
    options = CleanupOptions(rule, prefer_dir="/B")
    members = exact.duplicate_members(files(spark, ROWS))
    assert cleanup.kept_files(members, options).where("content_hash = 'h1'").first().path == kept
    plan = cleanup.cleanup_plan(members, options)
    assert plan.where("content_hash = 'h1'").count() == 2 and plan.where("path = keep_path").count() == 0
    assert tuple(cleanup.plan_totals(cleanup.execute(plan, options)).first()) == (3, 20)


def test_deletion(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("same")
    plan = spark.createDataFrame([("h", str(tmp_path / "a"), str(tmp_path / "b"), 4), ("h", str(tmp_path / "a"), str(tmp_path / "gone"), 4)], "content_hash string, keep_path string, path string, size bigint")
    assert cleanup.execute(plan).where("deleted").count() == 2 and (tmp_path / "b").exists()
    done = {r.path: r for r in cleanup.execute(plan, CleanupOptions(dry_run=False)).collect()}
    assert not (tmp_path / "b").exists() and done[str(tmp_path / "b")].deleted and done[str(tmp_path / "gone")].error


def greedy(sizes, tolerance):
    out, first = {}, None
    for s in sorted(sizes):
        if first is None or s > first * (1 + tolerance):
            first = s
        out[s] = first
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bands(spark, seed):
    sizes = [0, 100, 110, 120, 121, 140, 145, 146] if not seed else [random.Random(seed).randrange(5000) for _ in range(300)]
    d = spark.createDataFrame([(s,) for s in sizes], "size bigint")
    assert {r.size: r.band for r in banding.with_bands(d, 0.2).collect()} == greedy(sizes, 0.2)
    assert banding.band_anchors(d.where("false"), 0.2) == []


@pytest.mark.parametrize("seed", range(2))
def test_components_are_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def corpus(spark):
    rng = random.Random(9)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 20)):
            words[rng.randrange(60)] = f"other{rng.randrange(30)}"
        rows.append((f"/d/{i:03d}.txt", " ".join(words[: rng.randint(50, 60)])))
    rows += [("/d/cjk1.txt", "日本語の文章です"), ("/d/cjk2.txt", "日本語の文章でし"), ("/d/e1.txt", ""), ("/d/e2.txt", " \n")]
    return spark.createDataFrame(rows, "path string, text string").withColumn("size", F.octet_length("text").cast("bigint")).withColumn("extension", F.lit(".txt"))


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.5])
def test_pruning_loses_no_pair(spark, threshold):
    d = corpus(spark)
    banded = banding.with_bands(d, 0.2).withColumn("text", text.normalise(F.col("text")))
    all_pairs = near.blocked_pairs(banded, ["band", "extension"], ["text"]).select("file1", "file2", text.text_similarity(F.col("text1"), F.col("text2")).alias("s")).where(F.col("s") >= threshold - 1e-9)
    want = {(r.file1, r.file2): round(r.s, 9) for r in all_pairs.collect()}
    got = {(r.file1, r.file2): round(r.similarity, 9) for r in near.text_pairs(d, NearOptions(threshold=threshold)).collect()}
    assert got == want and len(want) > 20


def test_few_text_pairs_are_compared_by_words(spark, monkeypatch):
    """Unlike texts of common words aren't brought together; short and long texts, none, and rows that repeat a path have all their pairs."""
    monkeypatch.setattr(near, "SKETCHED", 50)
    rng, rows = random.Random(5), []
    for n, size, words in ((240, 100, 400), (60, 1200, 3000)):
        for i in range(n):
            some = rng.sample(range(words), size)
            rows.append((f"/{size}/{i:03d}.txt", " ".join(f"w{x:05d}" for x in some)))
            if i % 6 == 0:
                rows.append((f"/{size}/{i:03d}.like.txt", " ".join(f"w{x:05d}" for x in some[: size * 9 // 10] + rng.sample(range(words), size // 10))))
    rows += [("/e1.txt", "..."), ("/e2.txt", "!!!"), ("/e3.txt", None), ("/100/000.txt", rows[0][1])]
    d = spark.createDataFrame(rows, "path string, text string").withColumn("size", F.octet_length("text").cast("bigint")).withColumn("extension", F.lit(".txt"))
    banded = banding.with_bands(d, 0.2)
    made = {}

    def counted(df, what, *more, keep=near.materialise):
        made[what] = keep(df, what, *more)
        return made[what]

    monkeypatch.setattr(near, "materialise", counted)
    got = sorted((r.file1, r.file2, round(r.words, 9)) for r in near.text_candidates(banded, 0.85).collect())
    sets = [(r.path, r.band, frozenset(w for w in r.text.replace(".", " ").replace("!", " ").split())) for r in banded.where("text IS NOT NULL").collect()]
    share = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
    want = sorted((p, q, round(share(x, y), 9)) for p, b, x in sets for q, c, y in sets if b == c and p < q and share(x, y) >= 0.625 - 1e-9)
    assert got == want and len(want) > 45 and made["near-candidates"].count() < 1.2 * len(want)


def test_near_copies_in_many_cells(spark, monkeypatch):
    """A large group of near copies is compared in cells: all pairs are found with their values, and a text is sent to a cell once, not once for each of its pairs."""
    for name, value in (("SKETCHED", 40), ("COMPARED", 30), ("AT_ONCE", 100)):
        monkeypatch.setattr(near, name, value)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6):06d}" for _ in range(60)]
    rows = [(f"/{i:03d}.txt", "  ".join(w if rng.random() > 0.06 else f"x{rng.randrange(10**6):06d}" for w in base)) for i in range(120)]
    d = spark.createDataFrame(rows, "path string, text string").withColumn("size", F.octet_length("text").cast("bigint")).withColumn("extension", F.lit(".txt"))
    sent, keep = [], near.into_cells
    monkeypatch.setattr(near, "into_cells", lambda rows, *then: sent.append(rows) or keep(rows, *then))
    got = {(r.file1, r.file2): round(r.similarity, 9) for r in near.text_pairs(d).collect()}
    bodies = [(p, " ".join(t.split())) for p, t in rows]
    want = {}
    for k, (p, x) in enumerate(bodies):
        for q, y in bodies[k + 1 :]:
            v, w = set(x.split()), set(y.split())
            s = 0.6 * (1 - text.distance(x, y) / max(len(x), len(y))) + 0.4 * len(v & w) / len(v | w)
            if s >= 0.85 - 1e-9:
                want[p, q] = round(s, 9)
    assert got == want and len(want) > 3000
    assert sent[-1].where("kind = 0").count() <= 4 * 120 < sent[-1].where("kind = 1").count()


def test_near_groups(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.86), ("x", "y", 1.0)], "file1 string, file2 string, similarity double")
    members = near.near_members(pairs, "text")
    by = {r.path: r for r in members.collect()}
    assert {p: r.group_root for p, r in by.items()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert by["c"].similarity == 1.0 and by["c"].max_edge_similarity == 0.86 and by["a"].avg_edge_similarity == pytest.approx(0.88)
    groups = near.near_groups(members).orderBy("id").collect()
    assert [g.id for g in groups] == ["text-1", "text-2"] and groups[0].avg_similarity == 1.0
    assert near.near_summary(members).first().n_files == 5 and near.threshold_of("87.9") == 0.87


def test_media_pairs(spark):
    d = spark.createDataFrame([("a", 100, "video", "v1:1:0101:x"), ("b", 120, "video", "v1:1:0101:x"), ("c", 125, "video", None), ("d", 900, "video", "v1:1:0101:x"), ("e", 100, "audio", "a1:1:0101:x")], "path string, size bigint, media_type string, media_fingerprint string")
    assert [(r.file1, r.file2, r.similarity) for r in near.media_pairs(d, "video").collect()] == [("a", "b", 1.0)]


def test_media_pairs_of_any_lengths(spark, monkeypatch):
    """Dealt out in small tasks: the pairs and similarities of the plain comparison, whatever the fingerprints' lengths and signs."""
    monkeypatch.setattr(near, "DEALT", 8)
    rng, rows = random.Random(4), []
    for i, n in enumerate([0, 1, 56, 56, 64, 100, 320, 320, 321, 330, 640, 640] * 3):
        flips = {rng.randrange(n) for _ in range(n // 25)} if n else set()
        x = "".join(str((j * 7 // 3 + (j in flips)) % 2) for j in range(n))
        rows.append((f"p{i}", 100, "audio", f"a1:64:{x}:y"))
    rows += [("odd1", 100, "audio", "a1:64:01x1:y"), ("odd2", 100, "audio", "a1:64:01x1:z"), ("bare", 100, "audio", "a1"), ("none", 100, "audio", None), ("p3", 100, "audio", rows[2][3])]
    d = spark.createDataFrame(rows, "path string, size bigint, media_type string, media_fingerprint string")
    a, b = d.toDF(*(f"{c}1" for c in d.columns)), d.toDF(*(f"{c}2" for c in d.columns))
    s = bits.fingerprint_similarity(F.col("media_fingerprint1"), F.col("media_fingerprint2"))
    for threshold in (0.65, 0.85):
        want = a.join(b, F.col("path1") < F.col("path2")).select("path1", "path2", s.alias("s")).where(F.col("s") >= threshold)
        got = near.media_pairs(d, "audio", threshold).select("file1", "file2", "similarity")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_many_media_files_of_one_band(spark):
    import time

    rng = random.Random(8)
    marks = [rng.getrandbits(56) for _ in range(2000)]
    d = spark.createDataFrame([(str(i), 100, "video", f"v1:5:{x:056b}:y") for i, x in enumerate(marks)], "path string, size bigint, media_type string, media_fingerprint string")
    start = time.time()
    got = {(r.file1, r.file2) for r in near.media_pairs(d, "video", 0.7).collect()}
    took = time.time() - start
    want = {tuple(sorted((str(i), str(j)))) for i in range(2000) for j in range(i) if 1 - (marks[i] ^ marks[j]).bit_count() / 56 >= 0.7}
    assert got == want and len(want) > 100 and took < 60


def test_a_hot_key_of_pairs_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near, "DEALT", 8)
    rows = [(f"f{i:03d}", ".png", f"{i:064b}", (10.0 + i % 3, 10.0, 10.0, 0.3)) for i in range(100)] + [("f000", ".jpg", "0" * 64, (10.0, 10.0, 10.0, 0.3)), (None, ".png", "0" * 64, (10.0, 10.0, 10.0, 0.3))]
    d = spark.createDataFrame(rows, "path string, extension string, hash string, signature struct<r:double,g:double,b:double,variance:double>")
    got = near.image_pairs(d, 0.85)
    assert sorted((r.file1, r.file2) for r in got.collect()) == [(f"f{i:03d}", f"f{j:03d}") for i in range(100) for j in range(i + 1, 100)]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    ordered = near.blocked_pairs(d, ["extension"], ["hash"])
    assert all(r.file1 < r.file2 and (int(r.hash1, 2), int(r.hash2, 2)) == (int(r.file1[1:]), int(r.file2[1:])) for r in ordered.collect()) and ordered.count() == 4950


def test_image_pairs(spark):
    rows = [("a", ".png", "01" * 32, (10.0, 10.0, 10.0, 0.3)), ("b", ".png", "01" * 32, (12.0, 10.0, 10.0, 0.3)), ("c", ".jpg", "01" * 32, (10.0, 10.0, 10.0, 0.3)), ("d", ".png", "10" * 32, (200.0, 10.0, 10.0, 0.3))]
    d = spark.createDataFrame(rows, "path string, extension string, hash string, signature struct<r:double,g:double,b:double,variance:double>")
    assert [(r.file1, r.file2) for r in near.image_pairs(d).collect()] == [("a", "b")]


def test_index_chain(spark, tmp_path):
    def run(index, rows, rebuild=False):
        d = spark.createDataFrame(rows, "path string, size bigint, mtime_ms bigint, content binary")
        return index.process(d, ["/r"], rebuild)

    rows = [(f"/r/{i}", 3, i, b"abc") for i in range(13)]
    index = incremental.HashIndex(spark, str(tmp_path / "index"))
    run(index, rows)
    assert (index.hit_count, index.miss_count) == (0, 13)
    changed = [(*rows[0][:2], 99, b"abd"), *rows[1:]]
    done = run(incremental.HashIndex(spark, index.path), changed)
    again = incremental.HashIndex(spark, index.path).load()
    assert (again.hit_count, again.miss_count) == (12, 14) and done.select("content_hash").distinct().count() == 2
    more = incremental.HashIndex(spark, index.path)
    run(more, changed + [(f"/s/{i}", 1, i, b"x") for i in range(6)])
    s = more.stats()
    assert (s["hit_count"], s["miss_count"], s["total_entries"]) == (25, 20, 19) and s["hit_rate"] == pytest.approx(25 / 45)
    run(more, rows, rebuild=True)
    assert (more.hit_count, more.miss_count, more.stats()["total_entries"]) == (0, 0, 13)
    more.delete()
    assert incremental.HashIndex(spark, index.path).load().last_updated_at == 0
    assert "hit rate: 0.00%" in incremental.format_index_stats(more.stats())


def test_streaming_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(f"{i % 7}", i % 7, "/a" if i % 2 else "/b") for i in range(50)], "content_hash string, size bigint, source_root string")
    d.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    run, seen = StreamingDedupe(spark, str(tmp_path / "state")), []
    run.on_progress = seen.append
    run.run(stream)
    want = exact.duplicate_hashes(d.withColumn("path", F.lit("p")).withColumn("mtime", F.lit(0)))
    assert len(list((tmp_path / "state/state").iterdir())) <= 2
    assert len(seen) > 1 and sorted(map(tuple, run.groups().collect())) == sorted(map(tuple, want.collect()))


def test_scan_filter(spark):
    f = files(spark, ROWS)
    assert stats.extension_list(".A,b, .c") == (".a", ".b", ". .c") and stats.extension_list("") == ()
    assert stats.scan_filter(f, ScanOptions(1, 10, ("MD",))).count() == 1
    assert stats.top_extensions(f.where("size = 0")).first().share is None


def test_known_totals(spark):
    got = catalog.exact_summary(spark, "/root/testdata/sf0.01").first()
    assert (got.n_groups, got.total_duplicate_files, got.total_wasted_space, got.cross_directory_wasted_space) == (62, 135, 163961, 159365)


def test_report_json_has_all_groups(spark):
    import json

    from siltworks.plans import catalog

    sf = "/root/testdata/sf0.01"
    got = sorted(catalog.report_json(spark, sf).collect())
    want = sorted((-r.wasted_space, r.content_hash) for r in catalog.exact_groups(spark, sf).collect())
    found = [json.loads(r.json) for r in got]
    assert len(want) > 50 and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert [(-g["wasted_space"], g["content_hash"]) for g in found] == want and all(len(g["files"]) == g["n_files"] for g in found)
