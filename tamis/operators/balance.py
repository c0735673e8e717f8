"""Oversampling and targeted augmentation of rare classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.images import resize, rgb
from tamis.functions.keyed import SEED, key_code, key_uniform
from tamis.operators.splits import sample_with_replacement
from tamis.session import join_wanted, materialise

# Chances and ranges of the augmentation steps; fixed values.
FLIP_CHANCE = 0.5
ROTATE_CHANCE = 0.5
LIGHT_CHANCE = 0.5
LIGHT_LIMIT = 0.15
NOISE_CHANCE = 0.3
NOISE_VARIANCE = (5.0, 20.0)
IMAGE_SIZE = (224, 224)
# More copies of one source row than this are made in several tasks.
COPIES_PER_TASK = 100_000

IMAGE = "aug_key string, height int, width int, nChannels int, data binary"


def _needed(df: DataFrame, label: str, target_label: int, target_count: int) -> tuple[DataFrame, int]:
    source = df.filter(F.col(label) == target_label)
    return source, max(0, target_count - source.count())


def naive_oversample(
    df: DataFrame, key: str, label: str, target_label: int, target_count: int, seed: int = SEED
) -> DataFrame:
    """Append copies of rows of one class, drawn with replacement, up to ``target_count``."""
    source, missing = _needed(df, label, target_label, target_count)
    if missing == 0:
        return df
    draws = sample_with_replacement(source, key, missing, seed, "oversample")
    return df.unionByName(join_wanted(materialise(draws), source, key, "draw", COPIES_PER_TASK).drop("draw"))


def augmentation_plan(
    df: DataFrame, key: str, label: str, target_label: int, target_count: int, seed: int = SEED
) -> DataFrame:
    """One row per wanted copy: its key, source and the draw of every transform.

    Draws depend on the copy's key only.
    """
    source, missing = _needed(df, label, target_label, target_count)
    picks = sample_with_replacement(source, key, missing, seed, "augment")
    named = picks.withColumn("aug_key", F.concat_ws("_", F.lit("aug"), F.lit(str(target_label)), F.col("draw")))
    u = lambda use: key_uniform("aug_key", use, seed)
    span = lambda use: u(use) * (2 * LIGHT_LIMIT) - LIGHT_LIMIT
    lit_up = u("light") < LIGHT_CHANCE
    low, high = NOISE_VARIANCE
    return named.select(
        "aug_key",
        F.col(key).alias("source_key"),
        F.lit(target_label).alias(label),
        F.lit("train").alias("split"),
        (u("hflip") < FLIP_CHANCE).alias("hflip"),
        (u("vflip") < FLIP_CHANCE).alias("vflip"),
        F.when(u("rotate") < ROTATE_CHANCE, F.floor(u("quarter turns") * 4)).otherwise(0).cast("int").alias("rot90"),
        F.when(lit_up, span("contrast")).otherwise(0.0).alias("contrast"),
        F.when(lit_up, span("brightness")).otherwise(0.0).alias("brightness"),
        F.when(u("noise") < NOISE_CHANCE, u("variance") * (high - low) + low).otherwise(0.0).alias("noise_var"),
    )


def append_plan(df: DataFrame, plan: DataFrame, key: str, label: str) -> DataFrame:
    """The manifest with one row per planned copy, which carries its source's other columns.

    The key becomes a string. A source that is not in ``df`` has no copies.
    """
    taken = {key, label, "split"}
    sources = df.select(F.col(key).alias("source_key"), *[c for c in df.columns if c not in taken])
    wanted = materialise(plan.select(F.col("aug_key").alias("_copy"), "source_key", F.col(label).alias("_label"), F.col("split").alias("_split")))
    copies = join_wanted(wanted, sources, "source_key", "_copy", COPIES_PER_TASK).drop("source_key")
    added = copies.withColumnsRenamed({"_copy": key, "_label": label, "_split": "split"})
    base = df.withColumn(key, F.col(key).cast("string"))
    return base.unionByName(added, allowMissingColumns=True)


def _augmented(row, size: tuple[int, int]) -> bytes:
    image = resize(rgb(row.height, row.width, row.nChannels, row.data), *size)
    if row.hflip:
        image = image[:, ::-1]
    if row.vflip:
        image = image[::-1]
    image = np.rot90(image, row.rot90)
    image = image * (1.0 + row.contrast) + row.brightness * 255.0
    if row.noise_var > 0:
        noise = np.random.default_rng(row.noise_seed)
        image = image + noise.normal(0.0, np.sqrt(row.noise_var), image.shape)
    pixels = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(pixels[:, :, ::-1]).tobytes()


def apply_augmentation(
    images: DataFrame, plan: DataFrame, key: str, size: tuple[int, int] = IMAGE_SIZE, seed: int = SEED
) -> DataFrame:
    """Render the planned copies as pixel rows (BGR, three channels)."""
    pixels = images.select(F.col(key).alias("source_key"), "height", "width", "nChannels", "data")
    noise_seed = F.conv(F.substring(key_code("aug_key", "noise pixels", seed), 1, 8), 16, 10).cast("bigint")
    work = join_wanted(materialise(plan), pixels, "source_key", "aug_key", COPIES_PER_TASK)
    work = work.withColumn("noise_seed", noise_seed)
    # A copy grows to size * 3 bytes: hand them out in small batches.
    chunk = max(1, (16 << 20) // (size[0] * size[1] * 3))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk):
                part = batch.iloc[start : start + chunk]
                yield pd.DataFrame(
                    {
                        "aug_key": part["aug_key"],
                        "height": size[0],
                        "width": size[1],
                        "nChannels": 3,
                        "data": [_augmented(r, size) for r in part.itertuples(index=False)],
                    }
                )

    return work.mapInPandas(render, IMAGE)
