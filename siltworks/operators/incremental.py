"""The hash cache: a table of what was hashed before, joined to the files by path, size and time."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..schema import INDEX_ENTRY
from ..tables import materialise

CARRIED = ("content_hash", "approximate_fingerprint", "media_fingerprint")


def epoch_ms(column):
    return F.unix_millis(column)


def lookup(files: DataFrame, entries: DataFrame) -> DataFrame:
    """files with hit, and with hash and fingerprints from the entry of the same path, size and time in ms, if there is one."""
    old = entries.select("path", "size", F.col("mtime").alias("mtime_ms"), *(F.col(c).alias(f"old_{c}") for c in CARRIED), F.lit(True).alias("hit"))
    kept = files.drop(*(c for c in CARRIED if c in files.columns))
    if "mtime_ms" not in files.columns:
        kept = kept.withColumn("mtime_ms", epoch_ms(F.col("mtime")))
    found = kept.join(old, ["path", "size", "mtime_ms"], "left")
    return found.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumnsRenamed({f"old_{c}": c for c in CARRIED})


def hashed(found: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """Hashes what the lookup hasn't found."""
    return found.withColumn("content_hash", F.coalesce("content_hash", content_hash(F.col(content), algorithm))).drop(content)


def hit_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


def merged(entries: DataFrame, files: DataFrame, now_ms: int) -> DataFrame:
    """The entries after a run: those of hashed files replaced or added, others as they were, whether their files are there or not."""
    ms = F.col("mtime_ms") if "mtime_ms" in files.columns else epoch_ms(F.col("mtime"))
    new = files.where(F.col("content_hash").isNotNull()).select("path", "size", ms.alias("mtime"), *CARRIED, F.lit(now_ms).cast("bigint").alias("indexed_at"))
    return new.unionByName(entries.join(new.select("path"), "path", "left_anti").select(*new.columns))


@dataclass
class HashIndex:
    """A cache below a path: JSON lines, a header first, as one small file and the entries as Parquet. Anything that can't be read is as no cache."""

    spark: SparkSession
    path: str
    root_dirs: list[str] = field(default_factory=list)
    created_at: int = 0
    last_updated_at: int = 0
    hit_count: int = 0
    miss_count: int = 0
    version: int = 1

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(INDEX_ENTRY).parquet(f"{self.path}/entries-{self.last_updated_at}")
        except Exception:
            return self.spark.createDataFrame([], INDEX_ENTRY)

    def load(self) -> HashIndex:
        try:
            head = json.loads(self.spark.read.text(f"{self.path}/header").orderBy("value").first().value)
            for k in ("root_dirs", "created_at", "last_updated_at", "hit_count", "miss_count", "version"):
                setattr(self, k, head[k])
        except Exception:
            self.created_at = self.last_updated_at = self.hit_count = self.miss_count = 0
        return self

    def save(self, entries: DataFrame, now_ms: int | None = None) -> None:
        now = max(now_ms or int(time.time() * 1000), self.last_updated_at + 1)
        self.created_at = self.created_at or now
        entries.write.mode("overwrite").parquet(f"{self.path}/entries-{now}")
        self.last_updated_at = now
        head = {k: getattr(self, k) for k in ("version", "created_at", "last_updated_at", "root_dirs", "hit_count", "miss_count")}
        self.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/header")

    def process(self, files: DataFrame, root_dirs: list[str], rebuild: bool = False, now_ms: int | None = None) -> DataFrame:
        """The files with hashes; hits come from the cache, and the cache is written anew. A rebuild hashes all, and its
        counts of hits and misses begin at 0."""
        self.load()
        old = self.spark.createDataFrame([], INDEX_ENTRY) if rebuild or not self.last_updated_at else self.entries()
        done = materialise(hashed(lookup(files, old)), "hashed")
        counts = hit_counts(done).first()
        self.hit_count, self.miss_count = (0, 0) if rebuild else (self.hit_count + counts.hits, self.miss_count + counts.misses)
        self.root_dirs = sorted({*([] if rebuild else self.root_dirs), *root_dirs})
        now = max(now_ms or int(time.time() * 1000), self.last_updated_at + 1)
        self.save(merged(old, done, now), now)
        return done

    def stats(self) -> dict:
        seen = self.hit_count + self.miss_count
        return {
            "total_entries": self.entries().count(), "last_updated_at": self.last_updated_at, "created_at": self.created_at, "hit_count": self.hit_count,
            "miss_count": self.miss_count, "hit_rate": self.hit_count / seen if seen else 0.0, "root_dirs": self.root_dirs,
        }

    def delete(self) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.created_at = self.last_updated_at = self.hit_count = self.miss_count = 0


def format_index_stats(stats: dict) -> str:
    seen = stats["hit_count"] + stats["miss_count"]
    when = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(stats["last_updated_at"] / 1000))
    return f"entries: {stats['total_entries']:,} | last update: {when} | hit rate: {stats['hit_rate'] * 100:.2f}% ({stats['hit_count']}/{seen})"
