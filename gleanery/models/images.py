"""Image classification from files that Spark's image source decodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .base import Context, Fitted, fit_spark

SIDE, CELL = 64, 8


def _describe(height: int, width: int, channels: int, data: bytes) -> list[float]:
    """Resize to 64 x 64, average 8 x 8 cells per colour, and measure edges per cell."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float) / 255.0
    raw = np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, :3]
    small = raw[np.arange(SIDE) * height // SIDE][:, np.arange(SIDE) * width // SIDE]
    n = SIDE // CELL
    blocks = small.reshape(n, CELL, n, CELL, 3).mean(axis=(1, 3))
    grey = small.mean(axis=2)
    edges = np.abs(np.diff(grey, axis=0, prepend=grey[:1])) + np.abs(np.diff(grey, axis=1, prepend=grey[:, :1]))
    return np.concatenate([blocks.ravel(), edges.reshape(n, CELL, n, CELL).mean(axis=(1, 3)).ravel()]).tolist()


def image_features(images: DataFrame) -> DataFrame:
    """(path, features) from the ``image`` column of Spark's image source."""

    @F.pandas_udf("array<double>")
    def describe(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_describe(*row) for row in zip(h, w, c, d)])

    i = F.col("image")
    return images.select(i["origin"].alias("path"), array_to_vector(describe(i["height"], i["width"], i["nChannels"], i["data"])).alias("features"))


def fit_image_classifier(df: DataFrame, ctx: Context, max_iter: int = 200) -> Fitted:
    layers = [ctx.width, max(8, ctx.scaled(64)), max(2, ctx.classes)]
    return fit_spark(MultilayerPerceptronClassifier(layers=layers, maxIter=ctx.scaled(max_iter, 20), seed=ctx.seed), df)
