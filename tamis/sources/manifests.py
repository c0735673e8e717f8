"""Manifests and small result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, label int, split string"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest of known schema: CSV with a header, or Parquet if the path says so."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).csv(path, header=True)


def write_manifest(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    if path.rstrip("/").endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.csv(path, header=True)


def write_norm_stats(stats: DataFrame, path: str) -> None:
    """Per-channel statistics as one JSON record of two arrays; one row per channel comes in."""
    packed = F.sort_array(F.collect_list(F.struct("channel", "mean", "std")))
    row = stats.agg(packed.alias("c")).select(F.col("c.mean").alias("mean"), F.col("c.std").alias("std"))
    row.write.mode("overwrite").json(path)


def write_samples(images: DataFrame, path: str) -> None:
    """Generated samples as rows of pixels."""
    images.write.mode("overwrite").parquet(path)
