"""Prediction metrics and the early-stopping rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keyed import SCORE_SCALE, score_units
from tamis.functions.vectors import LOG_FLOOR, argmax_index, class_at, own_probability, place_of
from tamis.session import as_col

# Probabilities fall into this many equal ranges; each holds at most ~244,000 distinct values.
AUROC_RANGES = 4096


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 with positive class 1; undefined ratios are 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("_same"),
        F.count_if(y & p).alias("_tp"),
        F.count_if(~y & p).alias("_fp"),
        F.count_if(y & ~p).alias("_fn"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return counts.select(
        *by,
        "n",
        _ratio(F.col("_same"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _ranked_points(df: DataFrame, label: str, score: str, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per group: winning pairs ``_wins``, ``_pos``, ``_neg`` and the sums of further columns.

    Rows are first summed per distinct score (9 digits), then ranked within 4096 equal
    ranges of [0, 1] and last over the ranges: no step holds more than a bounded number
    of scores, however many rows share one.
    """
    by = list(by)
    width = SCORE_SCALE // AUROC_RANGES
    inside = F.when(F.col(score).between(0, 1), F.col(score))
    units = score_units(inside.otherwise(F.raise_error(F.lit("score outside [0, 1]"))))
    parts = {
        "_pos": F.when(F.col(label) == 1, 1.0).otherwise(0.0),
        "_neg": F.when(F.col(label) == 1, 0.0).otherwise(1.0),
        **{name: column.cast("double") for name, column in sums.items()},
    }
    points = (
        df.select(*by, units.alias("_q"), *[c.alias(name) for name, c in parts.items()])
        .groupBy(*by, "_q")
        .agg(*[F.sum(name).alias(name) for name in parts])
        .withColumn("_range", F.floor(F.col("_q") / width))
    )
    below = Window.partitionBy(*by, "_range").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_pos") * (F.coalesce(F.sum("_neg").over(below), F.lit(0.0)) + 0.5 * F.col("_neg"))
    names = ["_wins", *parts]
    ranges = (
        points.withColumn("_wins", wins).groupBy(*by, "_range").agg(*[F.sum(name).alias(name) for name in names])
    )
    # At most 4097 ranges per group are left.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_wins") + F.col("_pos") * F.coalesce(F.sum("_neg").over(lower), F.lit(0.0))
    return ranges.withColumn("_wins", wins).groupBy(*by).agg(*[F.sum(name).alias(name) for name in names])


def _area() -> Column:
    pairs = F.col("_pos") * F.col("_neg")
    return F.when(pairs > 0, F.col("_wins") / pairs)


def auroc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) of a probability; NULL with one class only."""
    return _ranked_points(df, label, score, by, {}).select(*by, _area().alias("auroc"))


def _own(label: str, probs: str, classes: Sequence | None) -> Column:
    """The label's probability; a label that is not among the classes has none."""
    return own_probability(probs, label if classes is None else place_of(label, classes))


def cross_entropy(df: DataFrame, label: str, probs: str, by: Sequence[str] = (), classes: Sequence | None = None) -> DataFrame:
    """Mean negative log probability of the given label.

    ``classes`` names the class at every place of ``probs``, here and below; by default 0..K-1.
    """
    loss = -F.log(F.greatest(_own(label, probs, classes), F.lit(LOG_FLOOR)))
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def predictions(
    df: DataFrame,
    key: str,
    label: str,
    probs: str,
    positive: int = 1,
    extra: Sequence[str] = (),
    classes: Sequence | None = None,
) -> DataFrame:
    """(``key``, ``label``, ``prediction``, ``positive_prob``) from a probability array."""
    best = argmax_index(probs)
    at = positive if classes is None else list(classes).index(positive)
    return df.select(
        key,
        label,
        (best if classes is None else class_at(best, classes)).alias("prediction"),
        F.element_at(as_col(probs), at + 1).alias("positive_prob"),
        *extra,
    )


def evaluate(
    df: DataFrame, key: str, label: str, probs: str = "probs", classes: Sequence | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The whole metric suite, one row per group, in one pass: loss, accuracy, precision, recall, f1, auroc."""
    scored = predictions(df.withColumn("_own", _own(label, probs, classes)), key, label, probs, extra=("_own", *by), classes=classes)
    y, p = F.col(label) == 1, F.col("prediction") == 1
    count = lambda condition: F.when(condition, 1).otherwise(0)
    totals = _ranked_points(
        scored,
        label,
        "positive_prob",
        by,
        {
            "_loss": -F.log(F.greatest(F.col("_own"), F.lit(LOG_FLOOR))),
            "_same": count(F.col(label) == F.col("prediction")),
            "_tp": count(y & p),
            "_fp": count(~y & p),
            "_fn": count(y & ~p),
        },
    )
    n = F.col("_pos") + F.col("_neg")
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return totals.select(
        *by,
        F.try_divide(F.col("_loss"), n).alias("loss"),
        _ratio(F.col("_same"), n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _area().alias("auroc"),
    )


def early_stop(history: DataFrame, run: str, epoch: str, metric: str, patience: int = 5) -> DataFrame:
    """Best epoch and stopping epoch per run.

    The best starts at 0.0 and must be strictly exceeded; a run stops at the first epoch
    that is ``patience`` epochs past its last improvement. ``history`` has one row per
    run and epoch (epochs 0, 1, ...), so a run is as short as its epoch limit.
    """
    # The greatest metric so far, at its first epoch; none before the first improvement.
    point = F.when(F.col(metric) > 0, F.struct(F.col(metric).alias("v"), (-F.col(epoch)).alias("e")))
    so_far = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    seen = history.withColumn("_best", F.max(point).over(so_far)).withColumn(
        "_last", F.coalesce(-F.col("_best.e"), F.lit(-1))
    )
    stops = F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch)))
    stopped = seen.withColumn("_stop", stops.over(Window.partitionBy(run)))
    reached = stopped.filter(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    best = F.max("_best")
    return reached.groupBy(run).agg(
        F.coalesce(-best["e"], F.lit(0)).cast("int").alias("best_epoch"),
        F.coalesce(best["v"], F.lit(0.0)).alias("best_f1"),
        F.max("_stop").cast("int").alias("stopped_at"),
    )
