"""Audio fingerprints of PCM samples."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import let

WINDOW, BINS, GROUP = 1024, 64, 4
#: Bytes of samples without which there is no fingerprint.
LEAST_BYTES = 1024


def window_bits(window: Column, bins: int = BINS) -> Column:
    """A bit for each of the window's bins: whether the sum of every second sample's size is the mean or more."""
    width = WINDOW // bins
    energies = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), lambda i: F.abs(F.get(window, b * width + 2 * i)).cast("double")), F.lit(0.0), lambda a, x: a + x) / width,
    )

    def flags(e: Column) -> Column:
        average = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / bins
        return let(average, lambda m: F.array_join(F.transform(e, lambda x: F.when(x >= m, "1").otherwise("0")), ""))

    return let(energies, flags)


def sample_bits(samples) -> str:
    """The bits of all whole windows. Each window's 64 bits are read as a double, so their last ones are rounded;
    the mean of four such numbers, rounded half up, is written with 64 binary digits or more."""
    import numpy as np

    x = np.abs(np.asarray(samples, dtype=np.float64))
    windows = x[: len(x) // WINDOW * WINDOW].reshape(-1, BINS, WINDOW // BINS)
    energies = windows[:, :, ::2].sum(axis=2) / (WINDOW // BINS)
    flags = energies >= energies.sum(axis=1, keepdims=True) / BINS
    values = [float(int("".join("01"[int(f)] for f in row), 2)) for row in flags]
    out = []
    for i in range(0, len(values), GROUP):
        part = values[i : i + GROUP]
        total = 0.0
        for v in part:
            total += v
        out.append(format(int(math.floor(total / len(part) + 0.5)) if total / len(part) < 2**52 else int(total / len(part)), "b").zfill(BINS))
    return "".join(out)


@F.pandas_udf(T.StringType())
def audio_fingerprint(samples: pd.Series) -> pd.Series:
    """Of 16-bit samples; null where there are less than LEAST_BYTES bytes of them."""

    def one(x):
        if x is None or 2 * len(x) < LEAST_BYTES:
            return None
        bits = sample_bits(x)
        return f"a1:{BINS}:{bits}:{hashlib.sha256(bits.encode()).hexdigest()[:16]}"

    return samples.map(one)
