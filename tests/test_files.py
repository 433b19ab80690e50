import json

import pytest

from siltworks.cli import main, options_of, parser
from siltworks.config import CleanupOptions, NearOptions, RunOptions, ScanOptions
from siltworks.operators import exact, near
from siltworks.plans import dedupe, report
from siltworks.sources import files
from siltworks.sources.ignore import IgnoreRules
from siltworks.sources.media import media_info, run_command, with_frames, with_samples, fingerprinted
from pyspark.sql import functions as F

TEXT = " ".join(f"line{i} of the report" for i in range(60))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, text in {
        "a.txt": TEXT, "b/a_copy.txt": TEXT, "b/near.txt": TEXT.replace("line7 ", "line seven "), "c/x.log": TEXT, "temp/t.txt": TEXT, "c/deep/er/e.md": "", "c/deep/f.md": "", ".gitignore": "*.log\n# no\ntemp/\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan(spark, tree):
    got = {r.path.removeprefix(f"{tree}/"): r for r in files.scan_files(spark, str(tree)).collect()}
    assert set(got) == {"a.txt", "b/a_copy.txt", "b/near.txt", "c/deep/er/e.md", "c/deep/f.md", ".gitignore"}
    assert got["c/deep/er/e.md"].depth == 3 and got["a.txt"].size == len(TEXT) and got[".gitignore"].extension == "(no extension)"
    default = {r.name for r in files.scan_files(spark, str(tree), ScanOptions(gitignore=False)).collect()}
    assert "t.txt" in default and "x.log" not in default
    assert files.scan_files(spark, str(tree), ScanOptions(min_size=1, extensions=("md", ".txt"))).count() == 3
    with pytest.raises(ValueError):
        files.scan_files(spark, str(tree / "missing"))


def test_roots(spark, tree):
    assert files.parse_directories(["a, b,", "b,c"]) == ["a", "b", "c"]
    both = files.scan_roots(spark, [str(tree), f"{tree}/b,{tree}/none"])
    assert both.count() == both.select("path").distinct().count() == 6
    with pytest.raises(ValueError):
        files.scan_roots(spark, [f"{tree}/none"])


def test_hashes_and_stream(spark, tree, tmp_path):
    import hashlib

    f = files.scan_files(spark, str(tree))
    got = {r.name: r.content_hash for r in files.hash_files(f).collect()}
    assert got["a.txt"] == hashlib.sha256(TEXT.encode()).hexdigest()
    assert {r.name: r.content_hash for r in files.hash_files(f, "md5", 10).collect()}["a.txt"] == hashlib.md5(TEXT[:10].encode()).hexdigest()
    seen = files.stream_files(spark, str(tree)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").where("name = 'a.txt'").first().size == len(TEXT)


@pytest.mark.parametrize(
    "patterns, path, want",
    [
        (["*.log"], "a/b.log", True), (["temp/"], "temp/x", True), (["temp/"], "a/temp", False), (["/a"], "b/a", False), (["a/**"], "a/b/c", True), (["a/**"], "x/a/b", False), (["**/x"], "a/b/x", True),
        (["*.t", "!k.t"], "d/k.t", False), (["d/", "!d/k.t"], "d/k.t", True), (["a?c"], "abc", True), (["[ab].x"], "b.x", True), (["[!ab].x"], "b.x", False), (["foo"], "a/foo/b", True), (["a/*"], "a/b/c", True), (["a/*"], "a", False),
        (["node_modules/**"], "node_modules/p/i.js", True), (["\\!x"], "!x", True),
    ],
)
def test_ignore(spark, patterns, path, want):
    rules = IgnoreRules(patterns)
    assert rules.ignores(path) == want and rules.kept([path]) == ([] if want else [path])
    assert spark.createDataFrame([(path,)], "p string").select(rules.column(F.col("p")).alias("i")).first().i == want
    assert not rules.ignores("") and not rules.ignores("../x")


def test_run_and_reports(spark, tree, tmp_path):
    options = RunOptions(near=NearOptions(), cleanup=CleanupOptions("mtime_oldest"), report="json", output=str(tmp_path / "out/r.json"), index=str(tmp_path / "index"))
    data = dedupe.run(spark, [str(tree)], options)
    assert data["exact"]["summary"]["n_groups"] == 2 and data["exact"]["summary"]["total_wasted_space"] == len(TEXT)
    assert data["near"]["text"] == [] and data["cleanup"]["deleted_count"] == 2 and (tree / "a.txt").exists()
    assert data["scan"]["index_stats"]["miss_count"] == 6
    again = dedupe.run(spark, [str(tree)], RunOptions(report="", index=str(tmp_path / "index")))
    assert again["scan"]["index_stats"]["hit_count"] == 6 and again["exact"]["summary"] == data["exact"]["summary"]
    loaded = json.loads((tmp_path / "out/r.json").read_text())
    assert loaded["generated_at"].endswith("Z") and loaded["exact"]["groups"][0]["n_files"] == 2
    (tree / "b/a_copy.txt").unlink()
    near = dedupe.run(spark, [str(tree)], RunOptions(near=NearOptions(), report=""))["near"]["text"]
    assert [sorted(f["path"].removeprefix(f"{tree}/") for f in g["files"]) for g in near] == [["a.txt", "b/near.txt"]] and near[0]["files"][0]["source_root"] == str(tree)
    data["near"], data["near_totals"] = {"text": near}, {"text": len(near)}
    markdown, page = report.to_markdown(data), report.to_html(data)
    assert "| a" in markdown.replace("\\", "") or "a.txt" in markdown.replace("\\", "") and "text\\-1" in markdown
    assert "class='high'" in page and "<script" not in page and "would delete 2 files" in report.console(data)


def test_json_has_all_groups(spark, tmp_path):
    n = report.EXACT_SHOWN + 25
    f = spark.createDataFrame([(f"/r/{i}-{j}", i, f"h{i:03d}", j, "/r") for i in range(1, n + 1) for j in range(2)], "path string, size long, content_hash string, mtime long, source_root string")
    groups = exact.exact_groups(f)
    pairs = spark.createDataFrame([(f"a{i:03d}", f"b{i:03d}", 0.9) for i in range(30)], "file1 string, file2 string, similarity double")
    found = near.near_groups(near.near_members(pairs, "text"))
    assert sorted((r.number, r.id, r.files[0].path) for r in found.collect()) == [(i + 1, f"text-{i + 1}", f"a{i:03d}") for i in range(30)]
    data = {"generated_at": None, "exact": {"summary": {"n_groups": n}, "groups": []}, "near": {"text": [], "image": []}, "note": "after"}
    path = report.export(data, "json", str(tmp_path / "all.json"), {"exact": groups, "near": found.orderBy("type", "number")})
    with open(path) as g:
        loaded = json.load(g)
    assert [x["size"] for x in loaded["exact"]["groups"]] == list(range(n, 0, -1)) and loaded["note"] == "after"
    assert [x["id"] for x in loaded["near"]["text"]] == [f"text-{i + 1}" for i in range(30)] and loaded["near"]["image"] == []


def test_sinks(tmp_path):
    assert report.escape_markdown("a_b|c*") == "a\\_b\\|c\\*" and report.escape_html("<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert [report.similarity_class(x) for x in (0.95, 0.9, 0.2)] == ["high", "medium", "low"]
    import datetime as dt

    assert report.default_name("markdown", "/x/dirA/", dt.datetime(2026, 6, 7, 8, 35, 37)) == "dedupe-report-dirA-2026-06-07T08-35-37.md"
    with pytest.raises(ValueError):
        report.export({}, "pdf", str(tmp_path / "x"))
    groups = [{"content_hash": str(i), "size": 1, "n_files": 2, "wasted_space": 1, "is_cross_directory": False, "files": [{"path": f"/p{i}", "mtime": 1, "source_root": None}]} for i in range(60)]
    data = {"generated_at": "now", "scan": {"roots": [], "total_files": 0, "total_size": 0, "scan_time": 0, "extensions": []}, "exact": {"summary": dict.fromkeys(("total_duplicate_files", "total_wasted_space", "cross_directory_wasted_space", "intra_directory_wasted_space"), 0) | {"n_groups": 60}, "groups": groups}}
    assert "10 more groups" in report.to_markdown(data) and report.to_markdown(data).count("## Group") == 50


def test_cli(spark, tree, tmp_path, capsys):
    o = options_of(parser().parse_args(["x", "-n", "-t", "90", "-c", "--prefer-dir", "/a", "--min-size", "3", "--extensions", "txt"]))
    assert o.near.threshold == 0.9 and o.cleanup.rule == "prefer_dir" and o.cleanup.dry_run and o.scan.extensions == (".txt",) and o.scan.min_size == 3
    assert main([str(tree), "-r", "markdown", "-o", str(tmp_path / "r.md"), "--index", str(tmp_path / "i"), "--show-index-stats"]) == 0
    assert "exact groups" in capsys.readouterr().out and (tmp_path / "r.md").exists()


def test_media(spark):
    probe = '{"streams":[{"codec_type":"audio","sample_rate":"44100","channels":2,"duration":"3.5"}],"format":{"duration":"4.25"}}'
    x = spark.createDataFrame([(probe,)], "p string").select(media_info(F.col("p"), "audio").alias("a"), media_info(F.col("p"), "video").alias("v")).first()
    assert x.a.duration == 4.25 and x.a.channels == 2 and x.v is None
    d = spark.createDataFrame([("p", 4.0), ("q", 0.0)], "path string, duration double")
    samples = fingerprinted(with_samples(d, lambda path, seconds: [1, -2] * 1024)).collect()
    assert samples[0].media_fingerprint.startswith("a1:64:") and samples[1].media_fingerprint is None
    frames = fingerprinted(with_frames(d, lambda path, at: [float(i % 9) for i in range(72)] if at > 0 else None)).collect()
    assert frames[0].media_fingerprint.startswith("v1:2:" + "1" * 128) and frames[1].media_fingerprint is None
    assert run_command(["false"]) is None and run_command(["sleep", "5"], 0.1) is None
