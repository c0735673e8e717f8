"""Statistics over decoded images (rows of height, width, nChannels, data)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.images import rgb
from tamis.functions.keyed import SEED
from tamis.operators.splits import sample_n

NORM_SAMPLE = 500


def normalization_stats(
    images: DataFrame, key: str, sample: int | None = NORM_SAMPLE, seed: int = SEED
) -> DataFrame:
    """Pixel-weighted mean and population std per RGB channel on a 0..1 scale.

    Pass train images only. Tasks send three sums per batch; ``sample=None`` uses all images.
    """
    chosen = images if sample is None else sample_n(images, key, sample, seed)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, squares, n = np.zeros(3, np.int64), np.zeros(3, np.int64), 0
            for r in batch.itertuples(index=False):
                pixels = rgb(r.height, r.width, r.nChannels, r.data).reshape(-1, 3).astype(np.int64)
                total += pixels.sum(axis=0)
                squares += (pixels**2).sum(axis=0)
                n += len(pixels)
            yield pd.DataFrame({"channel": [0, 1, 2], "s": total, "ss": squares, "n": n})

    sums = (
        chosen.select("height", "width", "nChannels", "data")
        .mapInPandas(partial, "channel int, s bigint, ss bigint, n bigint")
        .groupBy("channel")
        .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("s", "ss", "n")])
    )
    mean = F.col("s") / F.col("n") / 255.0
    square = F.col("ss") / F.col("n") / (255.0 * 255.0)
    return sums.select("channel", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def pixel_stats(images: DataFrame, key: str) -> DataFrame:
    """Mean, population std, min and max of every image's pixel values: a cheap feature vector."""
    fields = images.select(key, "data")
    schema = f"{fields.schema[key].simpleString().replace(':', ' ')}, mean double, std double, min int, max int"

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pixels = [np.frombuffer(d, np.uint8) for d in batch["data"]]
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "mean": [p.mean() for p in pixels],
                    "std": [p.std() for p in pixels],
                    "min": [p.min() for p in pixels],
                    "max": [p.max() for p in pixels],
                }
            )

    return fields.mapInPandas(features, schema)
