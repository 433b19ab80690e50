"""Functions of paths, names and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS, NO_EXTENSION, TEXT_EXTENSIONS, VIDEO_EXTENSIONS

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """From the name's last full stop on, in lower case; a name that only begins with one has none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)), F.lit("")), F.lit(NO_EXTENSION))


def relative(path: Column, root: Column) -> Column:
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(path)


def depth(path: Column, root: Column) -> Column:
    """Folders between the root and the file."""
    return F.size(F.split(relative(path, root), "/")) - 1


def media_type(
    ext: Column, text=TEXT_EXTENSIONS, image=IMAGE_EXTENSIONS, video=VIDEO_EXTENSIONS, audio=AUDIO_EXTENSIONS
) -> Column:
    return (
        F.when(ext.isin(*text), "text").when(ext.isin(*image), "image").when(ext.isin(*video), "video")
        .when(ext.isin(*audio), "audio").otherwise("other")
    )


def format_bytes(size: Column, decimals: int = 2) -> Column:
    """The largest unit of 1024 in which it is 1 or more, with so many decimals at most."""
    unit = F.lit(0)
    for k in range(1, len(UNITS)):
        unit = F.when(size >= 1024**k, F.lit(k)).otherwise(unit)
    value = F.round(size / F.pow(F.lit(1024.0), unit), decimals)
    shown = F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"\.?0+$" if decimals else "$^", "")
    return F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, UNITS)), unit + 1))


def format_bytes_py(size: float, decimals: int = 2) -> str:
    k = 0
    while k + 1 < len(UNITS) and size >= 1024 ** (k + 1):
        k += 1
    shown = f"{math.floor(size / 1024**k * 10**decimals + 0.5) / 10**decimals:.{decimals}f}"
    return (shown.rstrip("0").rstrip(".") if decimals else shown) + f" {UNITS[k]}"
