"""Colour signatures of images and image similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of the diagonal of the colour cube, as used to scale distances.
DIAGONAL = 441.67
SIGNATURE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("r", "g", "b", "variance")])


@F.pandas_udf(SIGNATURE)
def color_signature(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Mean colour, and the root mean square deviation from it as a share of 255, over every n-th pixel so
    that about 32 by 32 are looked at. data: BGR bytes row by row, as Spark's image source has them."""
    import numpy as np

    rows = []
    for w, h, raw in zip(width, height, data):
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w, -1)[:: max(1, h // 32), :: max(1, w // 32), :3].reshape(-1, 3)[:, ::-1].astype(float)
        average = pixels.mean(axis=0)
        rows.append((*average, float(np.sqrt(((pixels - average) ** 2).mean()) / 255)))
    return pd.DataFrame(rows, columns=["r", "g", "b", "variance"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def grey_grid(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
    """Grey values of an image reduced to 9 by 8 by averaging, for its difference hash."""
    import numpy as np

    out = []
    for w, h, raw in zip(width, height, data):
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w, -1)[:, :, :3][:, :, ::-1]
        grey = pixels @ np.array([0.299, 0.587, 0.114])
        ys, xs = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
        out.append([float(grey[ys[j] : max(ys[j] + 1, ys[j + 1]), xs[i] : max(xs[i] + 1, xs[i + 1])].mean()) for j in range(8) for i in range(9)])
    return pd.Series(out)


def color_distance(a: Column, b: Column) -> Column:
    """Of two signatures: the distance of their mean colours as a share of the cube's diagonal."""
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("g", "b")), (a["r"] - b["r"]) * (a["r"] - b["r"]))) / DIAGONAL


def image_similarity(differing: Column, a: Column, b: Column) -> Column:
    """Of two images with so many differing bits of 64 and these signatures. Flat images are compared by colour,
    flatter ones mostly so, others by 0.6 of the hash and 0.4 of the colour; far colours cap it."""
    shape, far = 1 - differing / 64, color_distance(a, b)
    tint = 1 - far
    v, w = a["variance"], b["variance"]
    weight = F.greatest(F.lit(0.1), F.greatest(v, w) / 0.05 * 0.5)
    similar = (
        F.when((v < 0.02) & (w < 0.02), tint)
        .when((v < 0.05) | (w < 0.05), F.least(shape * weight + tint * (1 - weight), tint + 0.1))
        .otherwise(0.6 * shape + 0.4 * tint)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similar, F.when(far > 0.2, 1 - 0.8 * far).otherwise(F.lit(1.0))))
