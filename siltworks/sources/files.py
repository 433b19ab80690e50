"""Files of directory trees. Trees are listed by the executors, a task for each folder at the top; contents are hashed as
streams, so no file has to fit into memory. Paths may be local or of a store that pyarrow knows."""

from __future__ import annotations

import hashlib
import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScanOptions
from ..functions import paths as P
from ..operators.stats import scan_filter
from .ignore import IgnoreRules

LOG = logging.getLogger(__name__)
CHUNK = 64 << 20
LISTED = "path string, size bigint, mtime timestamp"


def parse_directories(dirs: list[str]) -> list[str]:
    """Names separated by commas too, without blanks around them, each once, in order."""
    return list(dict.fromkeys(x.strip() for d in dirs for x in d.split(",") if x.strip()))


def open_path(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked_root(root: str) -> str:
    from pyarrow import fs

    root = root.rstrip("/") if "://" in root else os.path.abspath(root)
    store, name = open_path(root)
    if store.get_file_info(name).type != fs.FileType.Directory:
        raise ValueError(f"not a folder: {root}")
    return root


def ignore_rules(root: str, options: ScanOptions) -> IgnoreRules:
    """An ignore file that is named comes first; else the root's .gitignore, if there is one; without these, the default rules."""
    if options.ignore_file or options.gitignore:
        path = options.ignore_file or ".gitignore"
        path = path if path.startswith("/") or "://" in path else f"{root}/{path}"
        store, name = open_path(path)
        try:
            with store.open_input_stream(name, compression=None) as f:
                return IgnoreRules.parse(f.read().decode())
        except FileNotFoundError:
            return IgnoreRules()
    return IgnoreRules.default()


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of the regular files below a folder. Folders that can't be read are left out with a warning."""
    from pyarrow import fs

    store, name = open_path(root)
    top = store.get_file_info(fs.FileSelector(name))
    folders = [x.path for x in top if x.type == fs.FileType.Directory]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, todo = open_path(root)[0], [folder]
                while todo:
                    try:
                        found = store.get_file_info(fs.FileSelector(todo.pop()))
                    except OSError as e:
                        LOG.warning("left out: %s", e)
                        continue
                    files = [x for x in found if x.type == fs.FileType.File and not os.path.islink(x.path)]
                    if deep:
                        todo += [x.path for x in found if x.type == fs.FileType.Directory and not os.path.islink(x.path)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.path for x in files], pa.string()), pa.array([x.size for x in files], pa.int64()), pa.array([x.mtime for x in files], pa.timestamp("us", "UTC"))],
                        names=["path", "size", "mtime"],
                    )

    todo = spark.createDataFrame([(name, False)] + [(f, True) for f in folders], "folder string, deep boolean")
    return todo.repartition(len(folders) + 1).mapInArrow(run, LISTED)


def with_names(files: DataFrame, root: str) -> DataFrame:
    base = F.lit(open_path(root)[1])
    none = F.lit(None)
    return files.select(
        "path", P.basename(F.col("path")).alias("name"), "size", P.extension(F.col("path")).alias("extension"), "mtime", none.cast("timestamp").alias("atime"),
        none.cast("timestamp").alias("ctime"), P.depth(F.col("path"), base).alias("depth"), base.alias("source_root"),
    )


def scan_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The files of a tree that the rules and filters let pass."""
    root = checked_root(root)
    files = with_names(list_tree(spark, root), root)
    rules = ignore_rules(root, options)
    return scan_filter(files.where(~rules.column(P.relative(F.col("path"), F.col("source_root")))), options)


def scan_roots(spark: SparkSession, dirs: list[str], options: ScanOptions = ScanOptions()) -> DataFrame:
    """The files of several trees, each with its root; a root that isn't there is left out with a warning, and a file under two
    roots comes once, with the first."""
    found = None
    for k, root in enumerate(parse_directories(dirs)):
        try:
            files = scan_files(spark, root, options).withColumn("nth", F.lit(k))
        except (ValueError, OSError) as e:
            LOG.warning("left out: %s", e)
            continue
        found = files if found is None else found.unionByName(files)
    if found is None:
        raise ValueError("no folder to scan")
    columns = [c for c in found.columns if c not in ("path", "nth")]
    return found.groupBy("path").agg(F.min_by(F.struct(*columns), "nth").alias("f")).select("path", "f.*")


def hash_files(files: DataFrame, algorithm: str = "sha256", first: int | None = None) -> DataFrame:
    """files with content_hash, of the first bytes or of all; files that can't be read are left out."""
    schema = T.StructType([*files.drop("content_hash").schema, T.StructField("content_hash", T.StringType())])
    plain = files.drop("content_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    store, name = open_path(path)
                    digest, left = hashlib.new(algorithm), first
                    with store.open_input_stream(name, compression=None) as f:
                        while part := f.read(CHUNK if left is None else min(left, CHUNK)):
                            digest.update(part)
                            left = None if left is None else left - len(part)
                    out.append(digest.hexdigest())
                except OSError as e:
                    LOG.warning("left out: %s", e)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "content_hash"])

    return plain.mapInArrow(run, schema).where(F.col("content_hash").isNotNull())


def read_texts(files: DataFrame) -> DataFrame:
    """files with text: the contents as UTF-8, odd bytes replaced; files that can't be read are left out."""
    schema = T.StructType([*files.schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    store, name = open_path(path)
                    with store.open_input_stream(name, compression=None) as f:
                        out.append(f.read().decode("utf-8", "replace"))
                except OSError as e:
                    LOG.warning("left out: %s", e)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "text"])

    return files.mapInArrow(run, schema).where(F.col("text").isNotNull())


def stream_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """A stream of the files of a tree as they come, with their contents (Spark's own source: hidden files aren't seen)."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    x = reader.load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return x.select(path.alias("path"), P.basename(path).alias("name"), F.col("length").alias("size"), P.extension(path).alias("extension"), F.col("modificationTime").alias("mtime"), "content")
