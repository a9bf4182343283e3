"""Product features: name length, and mean and spread of pixels or arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basketlens.functions.columns import array_mean, array_std, name_length

COLOUR_CHANNELS = 3


def _pixel_moments(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    """Mean and population std of the colour channels; an image that did not decode has none."""
    for data, height, width, channels in batches:
        moments = []
        for blob, h, w, c in zip(data, height, width, channels):
            if blob is None or h <= 0 or w <= 0 or len(blob) != h * w * c:
                moments.append((None, None))
                continue
            pixels = np.frombuffer(blob, dtype=np.uint8).reshape(-1, int(c))[:, :COLOUR_CHANNELS]
            moments.append((float(pixels.mean()), float(pixels.std())))
        yield pd.DataFrame(moments, columns=["image_mean", "image_std"], dtype="float64")


_MOMENTS = StructType(
    [StructField("image_mean", DoubleType()), StructField("image_std", DoubleType())]
)
pixel_moments = F.pandas_udf(_pixel_moments, _MOMENTS)


def image_stats(images: DataFrame, key: str) -> DataFrame:
    """``key``, image_mean, image_std from a column ``image`` as Spark's image source gives it.

    Pixels go to Python once, in Arrow batches, and only two numbers come back.
    """
    image = F.col("image")
    moments = pixel_moments(image["data"], image["height"], image["width"], image["nChannels"])
    return images.select(key, moments.alias("_m")).select(key, "_m.image_mean", "_m.image_std")


def array_stats(df: DataFrame, key: str, array: str) -> DataFrame:
    """``key``, image_mean, image_std over all elements of a numeric array."""
    mean = df.select(key, array, array_mean(array).alias("image_mean"))
    return mean.select(
        key, "image_mean", array_std(array, F.col("image_mean")).alias("image_std")
    )


def text_features(articles: DataFrame) -> DataFrame:
    return articles.select(
        "product_id", "image_path", name_length("product_name").cast("int").alias("product_name_length")
    )


def product_features(articles: DataFrame, stats: DataFrame, key: str = "image_path") -> DataFrame:
    """One row per article; without a readable image the two image columns are null."""
    text = text_features(articles)
    return text.join(stats.select(key, "image_mean", "image_std"), key, "left").select(
        *text.columns, "image_mean", "image_std"
    )
