"""Exact duplicates of a stream of files: a table of counts by hash that each batch is merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import content_hash

STATE = "content_hash string, size bigint, n_files bigint, first_root string, last_root string"


def batch_counts(files: DataFrame) -> DataFrame:
    root = F.col("source_root") if "source_root" in files.columns else F.lit(None).cast("string")
    hashed = files if "content_hash" in files.columns else files.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.groupBy("content_hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n_files"), F.min(root).alias("first_root"), F.max(root).alias("last_root"))


def merged_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("content_hash").agg(F.min("size").alias("size"), F.sum("n_files").alias("n_files"), F.min("first_root").alias("first_root"), F.max("last_root").alias("last_root"))


def groups_of(state: DataFrame) -> DataFrame:
    return state.where("n_files > 1").select(
        "content_hash", "size", "n_files", (F.col("size") * (F.col("n_files") - 1)).alias("wasted_space"), F.coalesce(F.col("first_root") != F.col("last_root"), F.lit(False)).alias("is_cross_directory")
    )


class StreamingDedupe:
    """Runs a stream of files into a state below a folder. Batch n's state is written beside that of the batch before, so a batch that is
    run again gives the same; older ones are deleted. A restart goes on from the checkpoint."""

    def __init__(self, spark: SparkSession, folder: str, on_progress=None):
        self.spark, self.folder, self.on_progress = spark, folder.rstrip("/"), on_progress

    def state_path(self, batch: int) -> str:
        return f"{self.folder}/state/{batch:09d}"

    def states(self):
        """The file system and the paths of the states, oldest first."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, sorted((x.getPath() for x in fs.listStatus(place)), key=lambda x: int(x.getName())) if fs.exists(place) else []

    def state(self, batch: int | None = None) -> DataFrame:
        paths = [p for p in self.states()[1] if batch is None or int(p.getName()) < batch]
        return self.spark.read.schema(STATE).parquet(paths[-1].toString()) if paths else self.spark.createDataFrame([], STATE)

    def step(self, files: DataFrame, batch: int) -> None:
        merged_counts(self.state(batch), batch_counts(files)).write.mode("overwrite").parquet(self.state_path(batch))
        fs, paths = self.states()
        for old in [p for p in paths if int(p.getName()) < batch][:-1]:
            fs.delete(old, True)
        if self.on_progress:
            self.on_progress(batch)

    def run(self, stream: DataFrame) -> None:
        """Takes all that is there now."""
        query = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def groups(self) -> DataFrame:
        return groups_of(self.state())
