"""The whole run: scan, hash, exact groups, near groups, cleanup, report."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunOptions
from ..functions.paths import media_type
from ..operators import cleanup, exact, near, stats
from ..operators.incremental import HashIndex, hit_counts, lookup, merged
from ..schema import INDEX_ENTRY
from ..sources.files import hash_files, parse_directories, read_texts, scan_roots
from ..sources.media import read_images
from ..tables import materialise
from .report import EXACT_SHOWN, NEAR_SHOWN, default_name, export

KINDS = ("text", "image", "video", "audio")


def hash_incrementally(files: DataFrame, index: HashIndex, roots: list[str], rebuild: bool) -> DataFrame:
    """files with hashes; only those that the index hasn't are read."""
    index.load()
    old = index.entries() if index.last_updated_at and not rebuild else files.sparkSession.createDataFrame([], INDEX_ENTRY)
    found = lookup(files, old)
    known = found.where("hit")
    new = hash_files(found.where("NOT hit"))
    done = materialise(known.select(*new.columns).unionByName(new), "hashed")
    return recorded(index, done, roots, rebuild)


def recorded(index: HashIndex, done: DataFrame, roots: list[str], rebuild: bool) -> DataFrame:
    counts = hit_counts(done).first()
    old = index.entries() if index.last_updated_at and not rebuild else done.sparkSession.createDataFrame([], INDEX_ENTRY)
    index.hit_count, index.miss_count = (0, 0) if rebuild else (index.hit_count + counts.hits, index.miss_count + counts.misses)
    index.root_dirs = sorted({*([] if rebuild else index.root_dirs), *roots})
    now = max(int(time.time() * 1000), index.last_updated_at + 1)
    index.save(merged(old, done, now), now)
    return done


def near_members_of(spark: SparkSession, files: DataFrame, options) -> DataFrame:
    """Members of near groups of texts and images; videos and audio where files have fingerprints."""
    kinds = files.withColumn("media_type", media_type(F.col("extension"), options.text_extensions, options.image_extensions))
    texts = read_texts(kinds.where("media_type = 'text'").where(F.col("size") <= options.max_text_bytes))
    found = near.near_members(materialise(near.text_pairs(texts, options), "near-pairs"), "text")
    roots = [r.source_root for r in kinds.where("media_type = 'image'").select("source_root").distinct().collect()]
    for k, root in enumerate(sorted(roots)):
        images = read_images(spark, root) if not k else images.unionByName(read_images(spark, root))
    if roots:
        images = images.dropDuplicates(["path"]).join(kinds.select("path"), "path", "left_semi")
        found = found.unionByName(near.near_members(materialise(near.image_pairs(images, options.threshold), "near-pairs"), "image"))
    for kind in ("video", "audio"):
        if "media_fingerprint" in kinds.columns:
            found = found.unionByName(near.near_members(near.media_pairs(kinds, kind, options.threshold).select("file1", "file2", "similarity"), kind))
    return found


def run(spark: SparkSession, dirs: list[str], options: RunOptions = RunOptions()) -> dict:
    """Runs over the folders and returns the report's data, with the groups that reports show; the report is written if options name a
    format. A JSON report has all groups."""
    began = time.time()
    files = materialise(scan_roots(spark, dirs, options.scan), "scanned")
    totals = stats.scan_totals(files).first()
    roots = sorted(r.source_root for r in files.select("source_root").distinct().collect())
    data: dict = {
        "generated_at": dt.datetime.now(dt.timezone.utc),
        "scan": {
            "roots": roots, "total_files": totals.total_files, "total_size": totals.total_size, "scan_time": int((time.time() - began) * 1000), "ignored_count": 0,
            "extensions": [r.asDict() for r in stats.extension_stats(files).orderBy(F.desc("total_size"), "extension").collect()],
        },
    }
    if options.index:
        index = HashIndex(spark, options.index)
        hashed = hash_incrementally(files, index, roots, options.rebuild_index)
        data["scan"]["index_stats"] = index.stats()
    else:
        hashed = materialise(hash_files(stats.same_size(files)), "hashed")
    began = time.time()
    groups = materialise(exact.duplicate_hashes(hashed), "groups")
    members = exact.duplicate_members(hashed, groups)
    first = groups.orderBy(F.desc("wasted_space"), "content_hash").limit(EXACT_SHOWN).select("content_hash")
    shown = exact.exact_groups(hashed.join(first, "content_hash", "left_semi")).collect()
    tables = {"exact": exact.exact_groups(hashed)}
    data["exact"] = {"summary": exact.exact_summary(groups).first().asDict(), "groups": [g.asDict(recursive=True) for g in shown], "hash_time": int((time.time() - began) * 1000)}
    rule = options.cleanup
    if rule:
        keep = {r.content_hash: r.path for r in cleanup.kept_files(members.join(first, "content_hash", "left_semi"), rule).collect()}
        kept = cleanup.kept_files(members, rule).select("content_hash", F.col("path").alias("keep_path"))
        tables["exact"] = tables["exact"].join(kept, "content_hash", "left").orderBy(F.desc("wasted_space"), "content_hash")
        for g in data["exact"]["groups"]:
            g["keep_path"] = keep.get(g["content_hash"])
    if options.near:
        began = time.time()
        left = files.join(members.select("path"), "path", "left_anti")
        found = materialise(near.near_groups(near_members_of(spark, left, options.near), files), "near-groups")
        tables["near"] = found.orderBy("type", "number")
        some = found.where(F.col("number") <= NEAR_SHOWN).orderBy("type", "number").drop("number").collect()
        data["near"] = {k: [g.asDict(recursive=True) for g in some if g.type == k] for k in KINDS}
        counts = {r.type: r["count"] for r in found.groupBy("type").count().collect()}
        data["near_totals"] = {k: counts.get(k, 0) for k in KINDS}
        data["similarity_time"] = int((time.time() - began) * 1000)
    if rule and data["exact"]["summary"]["n_groups"]:
        done = materialise(cleanup.execute(cleanup.cleanup_plan(members, rule), rule), "cleanup")
        t = done.agg(F.count(F.when(F.col("deleted"), 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0)).alias("b")).first()
        errors = [f"{r.path}: {r.error}" for r in done.where("error IS NOT NULL").limit(1000).collect()]
        data["cleanup"] = {"rule": cleanup.keep_rule(rule)["description"], "dry_run": rule.dry_run, "deleted_count": t.n, "recovered_space": t.b, "errors": errors}
    if options.report:
        data["report_path"] = export(data, options.report, options.output or default_name(options.report, parse_directories(dirs)[0]), tables)
    return data
