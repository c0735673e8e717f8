"""The run log: one row per (experiment, condition, run, metric), partitioned for pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_index int, run_seed bigint, metric string, value double, experiment string, condition string"
RUN = ("experiment", "condition", "run_index")
# The four versions of a dataset that are compared, in reporting order; fixed values.
CONDITIONS = ("baseline", "cleaned", "noise_corrected", "dcai_improved")


def append_runs(runs: DataFrame, path: str, conditions: Sequence[str] = CONDITIONS) -> None:
    """Add whole runs; an unknown condition is an error. NaN is stored as NULL.

    A run is one partition (experiment, condition, run_index), and writing it again replaces it: an
    append that is repeated, or repeated after it failed halfway, leaves each run once.
    Other runs stay as they are. ``runs`` is read twice.
    """
    if not runs.filter(~F.col("condition").isin(list(conditions)) | F.col("condition").isNull()).isEmpty():
        raise ValueError(f"condition must be one of {list(conditions)}")
    clean = runs.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    names = [c.split()[0] for c in RUNS.split(", ")]
    by_run = clean.select(*names).repartition(*RUN)
    by_run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def read_runs(
    spark: SparkSession, path: str, experiment: str, condition: str | None = None
) -> DataFrame:
    """Runs of one experiment; only its partitions are read. An unknown experiment is an error."""
    runs = spark.read.schema(RUNS).parquet(path).filter(F.col("experiment") == experiment)
    if runs.isEmpty():
        raise ValueError(f"experiment {experiment!r} not found")
    return runs if condition is None else runs.filter(F.col("condition") == condition)


def present(runs: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose metric is neither NULL nor NaN."""
    return runs.filter(F.col(column).isNotNull() & ~F.isnan(column))


def metrics_to_wide(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per run, one column per metric."""
    keys = ["experiment", "condition", "run_index"]
    return runs.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def metrics_to_long(wide: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """One row per metric, its name prefixed (``val_``, ``test_``)."""
    metrics = [c for c in wide.columns if c not in keys]
    return wide.select(
        *keys,
        F.inline(
            F.array(
                *[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
            )
        ),
    )


def write_comparison(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
