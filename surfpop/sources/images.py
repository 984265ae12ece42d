"""Texture images as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfpop.functions import names

ROWS = 64  # image rows per Arrow batch


def _stem(origin) -> F.Column:
    return names.stem(names.base_name(origin), names.TEXTURE_SUFFIXES)


def texture_info(spark: SparkSession, path: str, topology_key: str) -> DataFrame:
    """textures(specimen_id, path, topology_key, width, height); pixels are not kept."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return images.select(
        _stem(F.col("image.origin")).alias("specimen_id"), F.col("image.origin").alias("path"),
        F.lit(topology_key).alias("topology_key"), F.col("image.width").cast("bigint").alias("width"),
        F.col("image.height").cast("bigint").alias("height"),
    )


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """pixels(texture_id, px, py, r, g, b, alpha) in [0, 1]; rows run from the top.

    Spark decodes the images; each is unpacked a band of rows at a time.
    """
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select(
        _stem(F.col("image.origin")).alias("texture_id"), "image.width", "image.height", "image.nChannels", "image.data"
    )

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, w, h, n, data in zip(b["texture_id"], b["width"], b["height"], b["nChannels"], b["data"]):
                grid = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                for top in range(0, h, ROWS):
                    band = grid[top:top + ROWS].reshape(-1, n) / 255.0
                    k = np.arange(len(band)) + top * w
                    if n == 1:
                        r = g = blue = band[:, 0]
                    else:
                        blue, g, r = band[:, 0], band[:, 1], band[:, 2]
                    alpha = band[:, 3] if n == 4 else np.ones(len(band))
                    yield pd.DataFrame({"texture_id": name, "px": k % w, "py": k // w, "r": r, "g": g, "b": blue, "alpha": alpha})

    return images.mapInPandas(unpack, "texture_id string, px bigint, py bigint, r double, g double, b double, alpha double")
