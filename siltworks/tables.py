"""Tables that cut the lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset in
    local mode, as in tests, a folder of this machine is set; on a cluster each machine would have its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='siltworks-')}"
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/siltworks/{what}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def materialise(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again. Nothing needs the shuffles behind the table any more; the
    driver's JVM is asked to collect its garbage, at which Spark removes their files from the executors."""
    path = shared_path(df.sparkSession, what) + "/table"
    df.write.parquet(path, compression=compression)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
