"""Class balance, breakdowns and annotator agreement."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.vectors import vector_sums
from tamis.session import join_small


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def imbalance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Majority and minority class with max/min count ratio; ties go to the smaller label."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    # Only classes are left here, so the order keys cost nothing.
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label")))
    last = F.min(F.struct(F.col("n"), F.col(label).alias("label")))
    return counts.groupBy(*by).agg(
        first["label"].alias("majority_class"),
        last["label"].alias("minority_class"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def label_audit(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Samples, counts per class (as a map) and imbalance ratio, overall or per group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    # One entry per class.
    entries = F.sort_array(F.collect_list(F.struct(F.col(label), F.col("n"))))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("n_samples"),
        F.map_from_entries(entries).alias("class_counts"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )


def label_audit_by(df: DataFrame, label: str, category: str) -> DataFrame:
    """Overall (NULL category) and per-category audit from one pass over the rows."""
    counts = df.groupBy(category, label).agg(F.count("*").alias("n"))
    # Classes per category are aggregated once more: over each category and over all.
    levels = counts.groupingSets(
        [[F.col(category), F.col(label)], [F.col(label)]], F.col(category), F.col(label)
    ).agg(F.sum("n").alias("n"), F.grouping(category).alias("is_overall"))
    return levels.groupBy("is_overall", category).agg(
        F.sum("n").alias("n_samples"),
        F.count("*").alias("n_classes"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )


def flagged_share(df: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """How many samples were flagged, and their fraction; keys are unique on both sides."""
    marked = join_small(df.select(key), issues.select(key, F.lit(1).alias("_flag")), key, "left")
    return marked.agg(
        F.count("*").alias("n_samples"),
        F.count("_flag").alias("n_flagged"),
        F.avg(F.coalesce("_flag", F.lit(0))).alias("flagged_fraction"),
    )


def breakdown(df: DataFrame, category: str, kind: str) -> DataFrame:
    return df.groupBy(category, kind).agg(F.count("*").alias("n"))


def distinct_kinds(df: DataFrame, category: str, kind: str) -> DataFrame:
    return df.groupBy(category).agg(F.countDistinct(kind).alias("n_kinds"))


# Registers of a sketch, as a power of two.
SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Relative standard error of the counts of merged sketches."""
    return 1.04 / math.sqrt(1 << bits)


def kind_sketches(df: DataFrame, by: list[str], kind: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(``by``, ``sketch``): a state of bounded size per group that can be stored and merged over loads.

    Absent kinds are not counted; a group of them alone has an empty sketch.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(kind).cast("string"), F.lit(bits)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch per group from those of several loads; merging in any order gives the same counts."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_kinds(sketches: DataFrame) -> DataFrame:
    """The approximate number of distinct kinds instead of the sketch."""
    return sketches.withColumn("n_kinds", F.hll_sketch_estimate("sketch")).drop("sketch")


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement beyond chance of two label columns; NULL when chance agreement is 1."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("a").alias("label"),
                    F.col("n").alias("n_a"),
                    F.lit(0).cast("bigint").alias("n_b"),
                    F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"),
                ),
                F.struct(
                    F.col("b").alias("label"),
                    F.lit(0).cast("bigint").alias("n_a"),
                    F.col("n").alias("n_b"),
                    F.lit(0).cast("bigint").alias("same"),
                ),
            )
        )
    )
    per_label = sides.groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("n_a", "n_b", "same")])
    totals = per_label.agg(
        F.sum("n_a").alias("n"), F.sum("same").alias("same"), F.sum(F.col("n_a") * F.col("n_b")).alias("cross")
    )
    po = F.col("same") / F.col("n")
    pe = F.col("cross") / (F.col("n") * F.col("n"))
    return totals.select(
        F.col("n").cast("bigint").alias("n"),
        po.alias("observed"),
        pe.alias("expected"),
        F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"),
    )


def vector_stats(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population standard deviation per dimension."""
    sums = vector_sums(df, [], vec, squares=True)
    dims = sums.select(F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "s"), "n")
    mean = F.col("s.sums") / F.col("n")
    variance = F.greatest(F.col("s.squares") / F.col("n") - mean * mean, F.lit(0.0))
    return dims.select("dim", mean.alias("mean"), F.sqrt(variance).alias("std"))
