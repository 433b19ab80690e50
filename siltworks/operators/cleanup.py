"""Keep rules, deletion plans and their execution, by default a dry run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEEP_RULES, CleanupOptions

DESCRIPTIONS = {
    "mtime_newest": "keep the newest file", "mtime_oldest": "keep the oldest file", "depth_shallowest": "keep the file with the fewest folders above it",
    "path_shortest": "keep the file with the shortest path", "name_pattern": "keep the newest file with one of the patterns in its name", "prefer_dir": "keep the newest file in the preferred folder",
}


def keep_rule(options: CleanupOptions) -> dict[str, str | None]:
    """type, value and description of the rule; an unknown one is as mtime_newest."""
    rule = options.rule if options.rule in KEEP_RULES else "mtime_newest"
    kind, _, value = rule.partition("_")
    value = {"name_pattern": "|".join(options.name_patterns), "prefer_dir": options.prefer_dir}.get(rule, value)
    return {"type": "prefer_dir" if rule == "prefer_dir" else kind, "value": value, "description": DESCRIPTIONS[rule]}


def keep_order(options: CleanupOptions) -> list[Column]:
    """The order of which a group's first file is kept; ties go to the smaller path."""
    newest = F.desc("mtime")
    order = {"mtime_oldest": [F.asc("mtime")], "depth_shallowest": [F.asc("depth")], "path_shortest": [F.asc(F.length("path"))]}
    if options.rule == "name_pattern":
        name = F.lower("name")
        hit = F.lit(False)
        for p in options.name_patterns:
            hit |= name.contains(p.lower())
        return [F.desc(hit), newest, F.asc("path")]
    if options.rule == "prefer_dir" and options.prefer_dir:
        folder = options.prefer_dir.lower()
        inside = F.coalesce(F.lower("source_root") == folder, F.lit(False)) | F.lower("path").startswith(folder)
        return [F.desc(inside), newest, F.asc("path")]
    return [*order.get(options.rule, [newest]), F.asc("path")]


def kept_files(members: DataFrame, options: CleanupOptions) -> DataFrame:
    """The file of each group (content_hash) that is kept."""
    return ranked(members, options).where("keep").drop("keep")


def ranked(members: DataFrame, options: CleanupOptions) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy(*keep_order(options)))
    return members.withColumn("keep", rank == 1)


def cleanup_plan(members: DataFrame, options: CleanupOptions = CleanupOptions()) -> DataFrame:
    """content_hash, keep_path, path, size: a row for each file that would go. members: as duplicate_members() has them."""
    rows = ranked(members, options)
    keep = rows.where("keep").select("content_hash", F.col("path").alias("keep_path"))
    return rows.where("NOT keep").select("content_hash", "path", "size").join(keep, "content_hash").select("content_hash", "keep_path", "path", "size")


def plan_groups(members: DataFrame, options: CleanupOptions = CleanupOptions()) -> DataFrame:
    """keep_path, n_delete, recoverable_space of each group, without lists of files."""
    rows = ranked(members, options)
    return rows.groupBy("content_hash").agg(
        F.max(F.when(F.col("keep"), F.col("path"))).alias("keep_path"), (F.count(F.lit(1)) - 1).alias("n_delete"), F.max("wasted_space").alias("recoverable_space")
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("deleted_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("recovered_space"))


def execute(plan: DataFrame, options: CleanupOptions = CleanupOptions(), confirm=None) -> DataFrame:
    """path, size, deleted, error of each file of the plan; confirm: a filter of the plan's columns. A dry run deletes nothing and
    has the same counts. Otherwise files go through Hadoop's file systems from the driver, in the order of the
    plan's rows, which are read a few at a time; a file that is gone already, as after a retry, counts as an error."""
    if confirm is not None:
        plan = plan.where(confirm)
    if options.dry_run:
        return plan.select("path", "size", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("error"))
    spark = plan.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for x in plan.select("path", "size").toLocalIterator():
        try:
            place = jvm.org.apache.hadoop.fs.Path(x.path)
            ok = bool(place.getFileSystem(conf).delete(place, False))
            done.append((x.path, x.size, ok, None if ok else "no such file"))
        except Exception as e:  # the next files go on
            done.append((x.path, x.size, False, str(e).splitlines()[0]))
    return spark.createDataFrame(done, "path string, size bigint, deleted boolean, error string")
