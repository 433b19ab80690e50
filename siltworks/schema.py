"""Schemas of the tables that operators take and return."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("extension", T.StringType(), False),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("atime", T.TimestampType()),
        T.StructField("ctime", T.TimestampType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("source_root", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("approximate_fingerprint", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("media_fingerprint", T.StringType()),
    ]
)
INDEX_ENTRY = "path string, size bigint, mtime bigint, content_hash string, approximate_fingerprint string, media_fingerprint string, indexed_at bigint"
INDEX_HEADER = "version int, created_at bigint, last_updated_at bigint, root_dirs array<string>, hit_count bigint, miss_count bigint"
PAIR = "file1 string, file2 string, similarity double, algorithm string, media_type string"
