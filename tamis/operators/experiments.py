"""Statistics over repeated runs and the comparison of dataset conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.keyed import SEED, key_uniform
from tamis.functions.stats import t_critical, t_two_sided_p
from tamis.operators.cleaning import select_split
from tamis.operators.metrics import evaluate
from tamis.operators.softmax import Fitted, fit_replicas, replica_probabilities
from tamis.session import materialise
from tamis.sources.runs import CONDITIONS, metrics_to_long, present

PRIMARY_METRIC = "test_f1"
LEVEL = 0.95


def moments(runs: DataFrame, metric: str, by: str = "condition") -> DataFrame:
    """(``by``, ``n_runs``, ``mean``, ``std``): sample deviation, 0 for a single run."""
    return (
        present(runs.filter(F.col("metric") == metric))
        .groupBy(by)
        .agg(
            F.count("*").alias("n_runs"),
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def run_summary(runs: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    return moments(runs, metric)


def with_interval(stats: DataFrame, level: float = LEVEL) -> DataFrame:
    """Add the t interval of the mean; a single run has the interval (mean, mean)."""
    t = t_critical(F.greatest(F.col("n_runs") - 1, F.lit(1)).cast("double"), level)
    half = F.when(F.col("n_runs") > 1, t * F.col("std") / F.sqrt("n_runs")).otherwise(0.0)
    return stats.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def comparison_table(
    runs: DataFrame, metric: str = PRIMARY_METRIC, conditions: Sequence[str] = CONDITIONS
) -> DataFrame:
    """One row per condition that has data, in the given order of conditions."""
    order = F.array_position(F.array(*[F.lit(c) for c in conditions]), F.col("condition"))
    table = with_interval(moments(runs.filter(F.col("condition").isin(list(conditions))), metric))
    # One row per condition.
    return table.orderBy(order).select("condition", "n_runs", "mean", "std", "ci_low", "ci_high")


def t_test(n_a: Column, mean_a: Column, std_a: Column, n_b: Column, mean_b: Column, std_b: Column) -> Column:
    """Pooled-variance t and two-sided p as a struct, from moments."""
    df = (n_a + n_b - 2).cast("double")
    pooled = ((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / df
    t = F.try_divide(mean_a - mean_b, F.sqrt(pooled * (1.0 / n_a + 1.0 / n_b)))
    return F.struct(t.alias("t_statistic"), t_two_sided_p(t, df).alias("p_value"))


def significance_test(
    runs: DataFrame, condition_a: str, condition_b: str, metric: str = PRIMARY_METRIC
) -> DataFrame:
    """Two-sided t-test between two conditions; fewer than two runs on a side is an error."""
    stats = moments(runs.filter(F.col("condition").isin(condition_a, condition_b)), metric)
    side = lambda c, field: F.max(F.when(F.col("condition") == c, F.col(field)))
    both = stats.agg(
        *[
            (F.coalesce(side(c, f), F.lit(0)) if f == "n_runs" else side(c, f)).alias(f"{f}_{s}")
            for s, c in (("a", condition_a), ("b", condition_b))
            for f in ("n_runs", "mean", "std")
        ]
    )
    enough = (F.col("n_runs_a") >= 2) & (F.col("n_runs_b") >= 2)
    test = t_test(*[F.col(f"{f}_{s}") for s in ("a", "b") for f in ("n_runs", "mean", "std")])
    checked = F.when(enough, test).otherwise(F.raise_error(F.lit("need at least two runs per condition")))
    return both.withColumn("_t", checked).select(
        F.lit(condition_a).alias("condition_a"),
        "mean_a",
        F.lit(condition_b).alias("condition_b"),
        "mean_b",
        "_t.t_statistic",
        "_t.p_value",
    )


def error_bars(table: DataFrame) -> DataFrame:
    return table.select(
        "condition",
        "mean",
        (F.col("mean") - F.col("ci_low")).alias("error_low"),
        (F.col("ci_high") - F.col("mean")).alias("error_high"),
    )


def bootstrap_weight(key: str, run_seed: int) -> Column:
    """How often a row enters one bootstrap resample: Poisson with mean 1, by key."""
    u = key_uniform(key, "bootstrap", run_seed)
    weight, mass, reached = F.lit(0), 0.36787944117144233, 0.0
    # beyond 18 the remaining mass is below the step of the draw, 2^-52
    for times in range(1, 19):
        reached += mass
        weight = weight + F.when(u >= F.lit(reached), 1).otherwise(0)
        mass /= times
    return weight.cast("double")


def scored_runs(
    df: DataFrame, key: str, label: str, vec: str, n_runs: int = 5, base_seed: int = SEED, reg: float = 0.01, max_passes: int = 200
) -> tuple[DataFrame, Fitted]:
    """Predictions of every run on the val and test rows, and the fits.

    (``run_index``, ``split``, ``key``, ``_y``, ``probs``). The runs are fitted together on
    the train rows, each with the weights of its own bootstrap; labels are 0..K-1.
    """
    rows = df.select(key, F.col(label).cast("int").alias("_y"), "split", F.col(vec).alias("_x"))
    weights = F.array(*[bootstrap_weight(key, base_seed + i) for i in range(n_runs)])
    # Every pass reads these rows.
    train = materialise(select_split(rows, "train").withColumn("_w", weights))
    n_classes = train.agg(F.max("_y")).first()[0]
    if n_classes is None:
        raise ValueError("no rows to fit on")
    fitted = fit_replicas(train, "_x", "_y", "_w", max(2, n_classes + 1), reg, max_passes)
    held = select_split(rows, "val").unionByName(select_split(rows, "test"))
    each = F.posexplode(replica_probabilities(held, "_x", fitted)).alias("run_index", "probs")
    return held.select("split", key, "_y", each), fitted


def run_condition(
    df: DataFrame,
    condition: str,
    key: str,
    label: str,
    vec: str,
    experiment: str,
    n_runs: int = 5,
    base_seed: int = SEED,
    reg: float = 0.01,
    max_passes: int = 200,
) -> DataFrame:
    """Fit and score the fixed model ``n_runs`` times on the same split; rows for the run log.

    The optimiser has no random start, so runs differ by a seeded bootstrap of the train
    rows. Hyper-parameters never depend on the condition.
    """
    if condition not in CONDITIONS:
        raise ValueError(f"condition must be one of {CONDITIONS}")
    scored, _ = scored_runs(df, key, label, vec, n_runs, base_seed, reg, max_passes)
    return log_of_runs(scored, condition, key, experiment, base_seed)


def log_of_runs(scored: DataFrame, condition: str, key: str, experiment: str, base_seed: int = SEED) -> DataFrame:
    """Rows for the run log from the predictions of ``scored_runs``."""
    by = ["run_index", "split"]
    long = metrics_to_long(evaluate(scored, key, "_y", by=by), by, "")
    return long.select(
        F.lit(experiment).alias("experiment"),
        F.lit(condition).alias("condition"),
        "run_index",
        (F.lit(base_seed).cast("bigint") + F.col("run_index")).alias("run_seed"),
        F.concat_ws("_", "split", "metric").alias("metric"),
        "value",
    )


def learning_curve(active: DataFrame, random: DataFrame) -> DataFrame:
    """Two histories side by side by number of labelled rows, with the gain of the first."""
    a = active.select("n_labeled", F.col("val_f1").alias("f1_active"))
    b = random.select("n_labeled", F.col("val_f1").alias("f1_random"))
    both = a.join(b, "n_labeled", "full_outer")
    return both.withColumn("gain", F.col("f1_active") - F.col("f1_random"))
