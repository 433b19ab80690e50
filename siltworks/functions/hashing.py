"""Hashes of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import QUICK_BYTES


def content_hash(data: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex; algorithms sha256, md5 and sha1."""
    data = data.cast("binary")
    if algorithm == "sha256":
        return F.sha2(data, 256)
    if algorithm in ("md5", "sha1"):
        return getattr(F, algorithm)(data)
    raise ValueError(f"unknown algorithm {algorithm}")


def quick_hash(data: Column, algorithm: str = "sha256", first: int = QUICK_BYTES) -> Column:
    """The hash of the first bytes alone."""
    return content_hash(F.substring(data.cast("binary"), 1, first), algorithm)
