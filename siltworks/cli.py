"""python -m siltworks.cli FOLDER...: finds duplicates, writes a report, and may delete."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import KEEP_RULES, CleanupOptions, NearOptions, RunOptions, ScanOptions
from .operators.incremental import HashIndex, format_index_stats
from .operators.near import threshold_of
from .operators.stats import extension_list
from .plans import dedupe, report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltworks", description=__doc__)
    p.add_argument("dirs", nargs="+", help="folders, also separated by commas")
    p.add_argument("-i", "--ignore-file")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("-e", "--exact", action="store_true", default=True)
    p.add_argument("-n", "--near", action="store_true")
    p.add_argument("-c", "--cleanup", action="store_true")
    p.add_argument("-r", "--report", choices=list(report.FORMATS), default="json")
    p.add_argument("-o", "--output")
    p.add_argument("--min-size", type=int)
    p.add_argument("--max-size", type=int)
    p.add_argument("--extensions", default="")
    p.add_argument("-t", "--threshold", default="85")
    p.add_argument("--keep-rule", choices=KEEP_RULES, default="mtime_newest")
    p.add_argument("--prefer-dir")
    p.add_argument("--index", help="folder of the hash cache")
    p.add_argument("--rebuild-index", action="store_true")
    p.add_argument("--show-index-stats", action="store_true")
    p.add_argument("--execute", action="store_true", help="delete; without it cleanup is a dry run")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--non-interactive", action="store_true")
    p.add_argument("--concurrency", type=int, help="Spark's cores decide; taken for compatibility")
    return p


def options_of(a: argparse.Namespace) -> RunOptions:
    rule = "prefer_dir" if a.prefer_dir and a.keep_rule == "mtime_newest" else a.keep_rule
    return RunOptions(
        scan=ScanOptions(a.min_size, a.max_size, extension_list(a.extensions), a.ignore_file, not a.no_gitignore),
        near=NearOptions(threshold=threshold_of(a.threshold)) if a.near else None,
        cleanup=CleanupOptions(rule, a.prefer_dir, dry_run=a.dry_run or not a.execute) if a.cleanup else None,
        report=a.report, output=a.output, index=a.index, rebuild_index=a.rebuild_index,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltworks").getOrCreate()
    data = dedupe.run(spark, a.dirs, options_of(a))
    print(report.console(data))
    if a.show_index_stats and a.index:
        print(format_index_stats(HashIndex(spark, a.index).load().stats()))
    print(data["report_path"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
