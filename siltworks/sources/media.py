"""Images, and media that only an external decoder reads. A decoder is any function; none has to be installed."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import audio, bits, color
from ..functions import paths as P

PROBE = "streams array<struct<codec_type:string,width:int,height:int,sample_rate:string,channels:int,duration:string>>, format struct<duration:string>"


@cache
def decoder_available(command: str = "ffmpeg") -> bool:
    return shutil.which(command) is not None


def run_command(args: list[str], timeout: float = 30) -> bytes | None:
    """What a command writes; null if it fails or takes too long."""
    try:
        return subprocess.run(args, capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, hash, signature of the images below a path; files that aren't images are left out."""
    x = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    origin = F.regexp_replace("origin", "^file:/+", "/")
    pixels = (F.col("width"), F.col("height"), F.col("data"))
    return x.where("height > 0").select(origin.alias("path"), P.extension(origin).alias("extension"), bits.difference_hash(color.grey_grid(*pixels)).alias("hash"), color.color_signature(*pixels).alias("signature"))


def media_info(probe: Column, kind: str) -> Column:
    """Of a probe's JSON the first stream of the kind (`video` or `audio`), and the duration in seconds."""
    x = F.from_json(probe, PROBE)
    stream = F.get(F.filter(x["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    seconds = F.coalesce(F.try_to_number(x["format"]["duration"], F.lit("999999999.999999999")), F.try_to_number(stream["duration"], F.lit("999999999.999999999")))
    return F.when(stream.isNotNull(), F.struct(*(stream[c].alias(c) for c in ("width", "height", "sample_rate", "channels")), seconds.cast("double").alias("duration")))


def ffmpeg_samples(path: str, seconds: float) -> list[int] | None:
    import numpy as np

    raw = run_command(["ffmpeg", "-v", "error", "-i", path, "-t", str(seconds), "-f", "s16le", "-ac", "1", "-ar", "44100", "-"]) if decoder_available() else None
    return None if raw is None else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").tolist()


def ffmpeg_frame(path: str, at: float) -> list[float] | None:
    """Grey values, 9 by 8, of the frame at that second."""
    args = ["ffmpeg", "-v", "error", "-ss", str(at), "-i", path, "-vframes", "1", "-vf", "scale=320:240,scale=9:8,format=gray", "-f", "rawvideo", "-"]
    raw = run_command(args, 15) if decoder_available() else None
    return [float(b) for b in raw] if raw and len(raw) == 72 else None


def with_samples(files: DataFrame, decode: Callable = ffmpeg_samples, most: float = 30) -> DataFrame:
    """files (path, duration) with samples: of the first seconds, as the decoder gives them, or null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield x.assign(samples=[decode(p, min(most, d)) if d and d > 0 else None for p, d in zip(x["path"], x["duration"])])

    return files.mapInPandas(run, T.StructType([*files.schema, T.StructField("samples", T.ArrayType(T.ShortType()))]))


def with_frames(files: DataFrame, decode: Callable = ffmpeg_frame) -> DataFrame:
    """files (path, duration) with frames: the difference hashes of the frames that could be read, and how many were asked for."""
    times = files.withColumn("times", bits.frame_schedule(F.col("duration")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield x.assign(grids=[[g for t in (ts if ts is not None else []) if (g := decode(p, t)) is not None] for p, ts in zip(x["path"], x["times"])])

    x = times.mapInPandas(run, T.StructType([*times.schema, T.StructField("grids", T.ArrayType(T.ArrayType(T.DoubleType())))]))
    return x.withColumn("requested", F.size("times")).withColumn("frames", F.transform("grids", lambda g: bits.difference_hash(g))).drop("times", "grids")


def fingerprinted(files: DataFrame) -> DataFrame:
    """files with media_fingerprint from samples or frames, whichever column there is."""
    mark = F.lit(None).cast("string")
    if "frames" in files.columns:
        mark = F.coalesce(mark, bits.video_fingerprint(F.col("frames"), F.col("requested")))
    if "samples" in files.columns:
        mark = F.coalesce(mark, audio.audio_fingerprint(F.col("samples")))
    return files.withColumn("media_fingerprint", mark)
