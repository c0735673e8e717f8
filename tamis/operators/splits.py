"""Stratified splits, folds and samples, all by rank in a keyed random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keyed import SEED, key_uniform, random_order
from tamis.operators.ranking import first_in_group, global_rank, rank_band
from tamis.session import join_small

SPLITS = ("train", "val", "test")


def allocate(count: Column, total: Column, m: Column, label: str, within: Sequence[str]) -> Column:
    """Largest-remainder shares of ``m`` in proportion to ``count``; ties to the smaller label."""
    wide = lambda c: c.cast("decimal(19,0)")
    # decimal(38,0): m * count may pass 64 bits.
    product = (wide(m) * wide(count)).cast("decimal(38,0)")
    safe_total = F.greatest(total, F.lit(1))
    left = product % wide(safe_total)
    base = ((product - left) / wide(safe_total)).cast("bigint")
    stratum = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    place = F.row_number().over(stratum.orderBy(left.desc(), F.col(label)))
    return base + F.when(place <= m - F.sum(base).over(stratum), 1).otherwise(0)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = SEED,
    within: Sequence[str] = (),
    out: str = "split",
) -> DataFrame:
    """Add the split name, keeping class shares; ``within`` splits each category apart."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split fractions must sum to 1")
    within = list(within)
    stratum = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    held_share = val / (val + test) if val + test > 0 else 0.0

    def bounds(sizes: DataFrame) -> DataFrame:
        sized = sizes.withColumn("_all", F.sum("n").over(stratum))
        sized = sized.withColumn("_m", F.floor(F.lit(train) * F.col("_all")))
        sized = sized.withColumn("_a", allocate(F.col("n"), F.col("_all"), F.col("_m"), label, within))
        sized = sized.withColumn("_rest", F.col("n") - F.col("_a"))
        sized = sized.withColumn("_rest_all", F.col("_all") - F.col("_m"))
        sized = sized.withColumn("_v", F.floor(F.lit(held_share) * F.col("_rest_all")))
        sized = sized.withColumn(
            "_b", allocate(F.col("_rest"), F.col("_rest_all"), F.col("_v"), label, within)
        )
        return sized.withColumn("bounds", F.array(F.col("_a"), F.col("_a") + F.col("_b")))

    banded = rank_band(df, random_order(key, "split", seed), bounds, [*within, label], "_band")
    name = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("_band") + 1)
    return banded.withColumn(out, name).drop("_band")


def stratified_kfold(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Add a fold number; within a class, fold sizes differ by at most one."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    # The first n % k folds take one row more.
    bounds = F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)),
        lambda i: (i * F.floor(F.col("n") / k) + F.least(i, F.col("n") % k)).cast("bigint"),
    )
    return rank_band(df, random_order(key, "fold", seed), lambda s: s.withColumn("bounds", bounds), [label], out)


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement, or all when there are fewer."""
    return first_in_group(df, random_order(key, "sample", seed), n)


def sample_per_class(df: DataFrame, key: str, label: str, n: int = 4, seed: int = SEED) -> DataFrame:
    """Up to ``n`` rows of every class."""
    return first_in_group(df, random_order(key, "grid", seed), n, [label])


def sample_with_replacement(
    df: DataFrame, key: str, n: int, seed: int = SEED, use: str = "draw"
) -> DataFrame:
    """``n`` independent draws: (``draw`` from 0, ``key``)."""
    spark = df.sparkSession
    keys = df.select(key)
    available = keys.count()
    if n <= 0:
        return keys.limit(0).select(F.lit(0).cast("bigint").alias("draw"), key)
    if available == 0:
        raise ValueError("nothing to draw from")
    ranked = global_rank(keys, random_order(key, use, seed), "_rank")
    hit = F.floor(key_uniform("draw", use, seed) * F.lit(float(available))) + 1
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_rank", hit)
    return join_small(draws, ranked, "_rank").select("draw", key)


def split_crosstab(df: DataFrame, category: str, split: str = "split") -> DataFrame:
    """Rows per category and split, absent combinations as 0."""
    return df.groupBy(category).pivot(split, list(SPLITS)).count().fillna(0, subset=list(SPLITS))


def seed_pool_split(
    df: DataFrame, key: str, label: str, fraction: float = 0.10, seed: int = SEED, out: str = "is_seed"
) -> DataFrame:
    """Mark the initially labelled share of every class; the rest is the pool."""

    def bounds(sizes: DataFrame) -> DataFrame:
        everything = Window.partitionBy(F.lit(0))
        sized = sizes.withColumn("_all", F.sum("n").over(everything))
        sized = sized.withColumn("_m", F.floor(F.lit(fraction) * F.col("_all")))
        share = allocate(F.col("n"), F.col("_all"), F.col("_m"), label, ())
        return sized.withColumn("bounds", F.array(share))

    banded = rank_band(df, random_order(key, "seed", seed), bounds, [label], "_band")
    return banded.withColumn(out, F.col("_band") == 0).drop("_band")


