"""Finding and fixing wrong labels by confident learning.

Out-of-sample probabilities come from a fixed probe, then the definition of Northcutt,
Jiang & Chuang (JAIR 2021) is applied: class thresholds, confident joint, calibration,
pruning and ranking. Only tables of class size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.arrow import once
from tamis.functions.keyed import NO_SCORE, SCORE_SCALE, SEED, key_uniform, random_order, score_order
from tamis.functions.vectors import argmax_index, class_at, entropy, largest_other, own_probability, place_of, vector_sums
from tamis.operators.cleaning import drop_listed, update_listed
from tamis.operators.ranking import BELOW_ALL, GroupSize, cuts_at_bounds, global_rank, rank_band
from tamis.operators.softmax import fit_replicas, replica_probabilities
from tamis.operators.splits import stratified_kfold
from tamis.session import bounded, join_small, local_table, materialise, small_rows

# Steepness of the probe's softmax over squared distances.
SHARPNESS = 10.0
PRUNE_METHODS = ("pbnr", "pbc", "both", "confident_joint")
RANK_METHODS = ("self_confidence", "normalized_margin", "confidence_weighted_entropy")


# --- probabilities -----------------------------------------------------------------


def class_list(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in small_rows(df.select(label).distinct(), "classes") if r[0] is not None)


def class_places(df: DataFrame, label: str, probs: str, classes: Sequence | None = None) -> list:
    """The class at every place of ``probs``: those given, else the sorted classes of the rows
    when there is one for each place, else 0..K-1. Anything else must be given."""
    if classes is not None:
        return list(classes)
    found = class_list(df, label)
    size = df.agg(F.max(F.size(probs)).alias("k")).first().k
    if size is None or len(found) == size:
        return found
    if set(found) <= set(range(size)):
        return list(range(size))
    raise ValueError(f"{len(found)} classes for {size} probabilities: name the classes in order")


def centroid_table(
    df: DataFrame, label: str, vec: str, classes: list, fold: str | None = None, dim: int | None = None
) -> np.ndarray:
    """Class centroids, (folds, classes, dim); with ``fold``, those of all other folds.

    A class without rows gets NaN.
    """
    groups = [label] if fold is None else [fold, label]
    rows = small_rows(vector_sums(df, groups, vec, dim=dim), "class centroids")
    if not rows:
        raise ValueError("no rows to fit on")
    dim = len(rows[0].sums)
    n_folds = 1 if fold is None else max(r[fold] for r in rows) + 1
    sums = np.zeros((n_folds, len(classes), dim))
    counts = np.zeros((n_folds, len(classes), 1))
    place = {c: i for i, c in enumerate(classes)}
    for r in rows:
        at = (0 if fold is None else r[fold], place[r[label]])
        sums[at], counts[at] = r.sums, r.n
    if fold is not None:
        sums, counts = sums.sum(axis=0) - sums, counts.sum(axis=0) - counts
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums / counts


def centroid_probabilities(
    df: DataFrame, vec: str, centroids: np.ndarray, fold: str | None = None, sharpness: float = SHARPNESS
) -> Column:
    """Softmax over negative squared distances to the centroids, rounded to 9 digits.

    The dense product runs on Arrow batches: one matrix product per batch instead of
    classes times dimensions interpreted lambda calls per row.
    """
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def probabilities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        centres = shared.value
        norms = np.where(np.isnan(centres).any(axis=2), np.inf, (centres**2).sum(axis=2))
        filled = np.nan_to_num(centres)
        for folds, vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            out = np.empty((len(x), centres.shape[1]))
            which = folds.to_numpy()
            for f in np.unique(which):
                mine = which == f
                # The row's own squared norm cancels in the softmax.
                logits = sharpness * (2.0 * x[mine] @ filled[f].T - norms[f])
                logits -= logits.max(axis=1, keepdims=True)
                e = np.exp(logits)
                out[mine] = e / e.sum(axis=1, keepdims=True)
            yield pd.Series(list(np.round(out, 9)))

    udf = once(F.pandas_udf(probabilities, "array<double>"))
    return udf(F.lit(0) if fold is None else F.col(fold), F.col(vec))


def oos_probabilities(
    df: DataFrame,
    key: str,
    label: str,
    vec: str,
    k: int = 5,
    seed: int = SEED,
    classes: list | None = None,
    sharpness: float = SHARPNESS,
) -> DataFrame:
    """Every row scored by a model that was not fitted on it: (``key``, ``label``, ``fold``, ``probs``).

    One aggregation serves all folds: a fold's model is the total minus the fold.
    ``probs`` follows the sorted classes. Pass train rows only.
    """
    classes = class_list(df, label) if classes is None else classes
    folded = stratified_kfold(df.select(key, label, vec), key, label, k, seed)
    centroids = centroid_table(folded, label, vec, classes, "fold")
    return folded.select(
        key, label, "fold", centroid_probabilities(folded, vec, centroids, "fold", sharpness).alias("probs")
    )


def oos_probabilities_logistic(
    df: DataFrame,
    key: str,
    label: str,
    vec: str,
    k: int = 5,
    seed: int = SEED,
    reg: float = 0.01,
    max_passes: int = 200,
) -> DataFrame:
    """The same with a multinomial logistic regression per fold, all folds fitted together.

    A row weighs 0 in the fit of its own fold. A class that the rows of a fit lack has
    probability 0; a null vector has null probabilities.
    """
    classes = class_list(df, label)
    folded = stratified_kfold(df.select(key, label, vec), key, label, k, seed)
    others = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.when(f == F.col("fold"), 0.0).otherwise(1.0))
    # Every pass reads these rows.
    rows = materialise(folded.withColumns({"_y": place_of(label, classes), "_w": others}))
    fitted = fit_replicas(rows, vec, "_y", "_w", len(classes), reg, max_passes)
    return rows.select(key, label, "fold", replica_probabilities(rows, vec, fitted, "fold").alias("probs"))


# --- confident learning ------------------------------------------------------------


def _class_table(df: DataFrame, label: str, probs: str, classes: list) -> DataFrame:
    """Per class: rows, mean own probability (9 digits), ends of the probabilities, rows without some."""
    place = place_of(label, classes)
    own = own_probability(probs, place)
    lacking = F.exists(probs, lambda p: p.isNull() | F.isnan(p))
    return df.filter(place.isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"),
        F.round(F.avg(own), 9).alias("threshold"),
        F.min(F.array_min(probs)).alias("low"),
        F.max(F.array_max(probs)).alias("high"),
        F.count_if(F.coalesce(lacking, F.lit(True))).alias("n_lacking"),
    )


def class_thresholds(df: DataFrame, label: str, probs: str = "probs", classes: Sequence | None = None) -> DataFrame:
    """Per class: rows and mean own probability (9 digits). Rows without a known label are left out."""
    return _class_table(df, label, probs, class_places(df, label, probs, classes)).select(label, "n", "threshold")


def suggested_class(probs: str, thresholds: list[float]) -> Column:
    """Most probable class among those at or above their threshold, or NULL."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    eligible = F.zip_with(F.col(probs), limits, lambda p, t: F.when(F.round(p, 9) >= t, p).otherwise(-1.0))
    return F.when(F.array_max(eligible) >= 0, argmax_index(eligible)).cast("int")


def _confident(df: DataFrame, label: str, probs: str, classes: list) -> tuple[list, Column]:
    """Rows of the class table, and the place of the class that a row's probabilities suggest."""
    found = small_rows(_class_table(df, label, probs, classes), "classes")
    # A class without rows has no threshold and attracts nothing.
    limits = dict.fromkeys(classes, math.inf) | {r[label]: r.threshold for r in found}
    return found, suggested_class(probs, [limits[c] for c in classes])


def confident_joint(df: DataFrame, label: str, probs: str = "probs", classes: Sequence | None = None) -> DataFrame:
    """(``label``, ``suggested``, ``n``, ``calibrated``, ``quota``) for every cell that holds rows.

    ``calibrated`` scales each label's cells to its true count; ``quota`` rounds it. The
    cells, up to the square of the number of classes, stay in Spark.
    """
    classes = class_places(df, label, probs, classes)
    return _joint(df, label, classes, *_confident(df, label, probs, classes))


def _joint(df: DataFrame, label: str, classes: list, found: list, suggested: Column) -> DataFrame:
    cells = df.select(label, class_at(suggested, classes).alias("suggested")).filter("suggested IS NOT NULL")
    cells = cells.groupBy(label, "suggested").agg(F.count("*").alias("_n"))
    kind = df.schema[label].dataType.simpleString()
    sizes = local_table(df.sparkSession, [(r[label], r.n) for r in found], f"`{label}` {kind}, _size bigint")
    # A label without a confident row stands for itself.
    filled = F.broadcast(sizes).join(cells, label, "left").select(
        label, F.coalesce("suggested", F.col(label)).alias("suggested"), F.coalesce("_n", "_size").alias("n"), "_size"
    )
    # At most one row per class in a partition.
    total = F.sum("n").over(Window.partitionBy(label))
    scaled = filled.withColumn("calibrated", F.col("n") / total * F.col("_size")).drop("_size")
    return scaled.withColumn("quota", F.floor(F.col("calibrated") + 0.5))


def rank_score(label: str, probs: str, rank_by: str) -> Column:
    """Severity score; low is worst, except for the entropy where high is worst."""
    own = own_probability(probs, label)
    if rank_by == "self_confidence":
        return own
    if rank_by == "normalized_margin":
        return (own - largest_other(probs, label) + 1.0) / 2.0
    if rank_by == "confidence_weighted_entropy":
        return entropy(probs) / (F.log(F.size(probs).cast("double")) * F.greatest(own, F.lit(1e-6)))
    raise ValueError(f"rank_by must be one of {RANK_METHODS}")


def _marked_by_noise_rate(rows: DataFrame, key: str, place: str, probs: str, joint: DataFrame, found: list, size: int, out: str) -> DataFrame:
    """Mark, per (class i, other class j), the ``quota`` rows of i with the largest p_j - p_i.

    The cuts of all cells are found together: the gaps of a row to the classes that have a quota are
    counted where the row is scanned, and nothing but counters leaves the scan. A row is
    then compared with the cuts of its class's cells in one expression.
    """
    quotas = joint.filter((F.col(place) != F.col("suggested")) & (F.col("quota") > 0))
    quotas = quotas.select(place, F.col("suggested").alias("_other"), "quota")
    few = bounded(quotas)
    own = own_probability(probs, place)
    gap = lambda p: score_order(p - own, key, descending=True)
    if few is None:
        return _marked_by_many_cells(rows, key, place, probs, quotas, out)
    cells = [(r[place], r._other, r.quota) for r in few.collect()]
    others: dict[int, list[int]] = {}
    for i, j, _ in cells:
        others.setdefault(i, []).append(j)
    table = local_table(rows.sparkSession, list(others.items()), f"{place} int, _others array<int>")
    order = gap(F.element_at(probs, F.col("_other") + 1))
    long = rows.join(F.broadcast(table), place).select("*", F.explode("_others").alias("_other"))
    long = long.select(F.concat_ws(":", place, "_other").alias("_g"), order.head.alias("_head"), order.tail.alias("_tail"))
    by_class = {r[place]: r for r in found}
    span = max((r.high - r.low for r in found if r.high is not None), default=0.0)
    end = NO_SCORE if any(r.n_lacking for r in found) or not math.isfinite(span) else math.ceil(span * SCORE_SCALE) + 1
    cuts = cuts_at_bounds(long, [GroupSize(f"{i}:{j}", by_class[i].n, -end, end, [quota]) for i, j, quota in cells])
    lines = []
    for i, listed in others.items():
        mine = [cuts[f"{i}:{j}"][0] if j in listed else BELOW_ALL for j in range(size)]
        lines.append((i, [h for h, _ in mine], [t for _, t in mine]))
    ends = local_table(rows.sparkSession, lines, f"{place} int, _heads array<bigint>, _tails array<string>")

    def within(p: Column, cut: Column) -> Column:
        order = gap(p)
        return (order.head < cut["_heads"]) | ((order.head == cut["_heads"]) & (order.tail <= cut["_tails"]))

    hits = F.zip_with(F.col(probs), F.arrays_zip("_heads", "_tails"), within)
    marked = rows.join(F.broadcast(ends), place, "left")
    return marked.withColumn(out, F.coalesce(F.exists(hits, lambda hit: hit), F.lit(False))).drop("_heads", "_tails")


def _marked_by_many_cells(rows: DataFrame, key: str, place: str, probs: str, quotas: DataFrame, out: str) -> DataFrame:
    """The same when the cells are too many for the driver: a row per cell, ranked within it."""
    others = quotas.groupBy(place).agg(F.collect_list("_other").alias("_others"))
    own = own_probability(probs, place)
    gaps = F.transform("_others", lambda j: F.struct(j.alias("_other"), (F.element_at(probs, j + 1) - own).alias("_gap")))
    cells = join_small(rows, others, place).select(key, place, F.inline(gaps))

    def bounds(sizes: DataFrame) -> DataFrame:
        return join_small(sizes, quotas, [place, "_other"]).withColumn("bounds", F.array("quota"))

    banded = rank_band(cells, score_order("_gap", key, descending=True), bounds, [place, "_other"], "_band")
    listed = banded.filter("_band = 0").select(key).distinct().withColumn(out, F.lit(True))
    return rows.join(listed, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _marked_by_class(rows: DataFrame, key: str, place: str, probs: str, joint: DataFrame, out: str) -> DataFrame:
    """Mark, per class i, as many of its least confident rows as the joint puts off the diagonal.

    Rows of no class are left out.
    """
    off = F.when(F.col(place) != F.col("suggested"), F.col("calibrated")).otherwise(0.0)
    quotas = joint.groupBy(place).agg(F.floor(F.sum(off) + 0.5).alias("quota"))
    least_sure = score_order(own_probability(probs, place), key)

    def bounds(sizes: DataFrame) -> DataFrame:
        return join_small(sizes, quotas, place).withColumn("bounds", F.array("quota"))

    banded = rank_band(rows.filter(F.col(place).isNotNull()), least_sure, bounds, [place], "_band")
    return banded.withColumn(out, F.col("_band") == 0).drop("_band")


def label_issues(
    df: DataFrame,
    key: str,
    label: str,
    probs: str = "probs",
    method: str = "pbnr",
    rank_by: str = "self_confidence",
    classes: Sequence | None = None,
) -> DataFrame:
    """Likely mislabelled rows, worst first: (``key``, ``label``, ``score``, ``issue_rank``).

    ``classes`` names the class at every place of ``probs``, see ``class_places``. Rows whose
    label is NULL or not among them are never listed. ``df`` is read several times: pass
    materialised probabilities.
    """
    if method not in PRUNE_METHODS:
        raise ValueError(f"method must be one of {PRUNE_METHODS}")
    classes = class_places(df, label, probs, classes)
    places = list(range(len(classes)))
    place = "_place"
    score = rank_score(place, probs, rank_by)
    rows = df.select(key, place_of(label, classes).alias(place), probs)
    found, suggested = _confident(rows, place, probs, places)
    if method == "confident_joint":
        hit = rows.filter(suggested != F.col(place))
    else:
        joint = _joint(rows, place, places, found, suggested)
        hit = rows
        if method in ("pbnr", "both"):
            hit = _marked_by_noise_rate(hit, key, place, probs, joint, found, len(places), "_by_rate").filter("_by_rate")
        if method in ("pbc", "both"):
            # the ranks are those among all rows of a class
            marked = _marked_by_class(rows, key, place, probs, joint, "_by_class").filter("_by_class")
            hit = marked if method == "pbc" else hit.join(marked.select(key), key, "left_semi")
    hit = hit.filter(argmax_index(probs) != F.col(place)).select(key, class_at(place, classes).alias(label), score.alias("score"))
    worst_first = score_order("score", key, descending=rank_by == "confidence_weighted_entropy")
    return global_rank(hit, worst_first, "issue_rank")


# --- correction and validation -----------------------------------------------------


def remove_flagged(df: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    return drop_listed(df, issues, key)


def relabel_flagged(
    df: DataFrame,
    issues: DataFrame,
    scored: DataFrame,
    key: str,
    label: str,
    min_confidence: float | None = None,
    classes: Sequence | None = None,
) -> DataFrame:
    """Give flagged rows their most probable class, on request only when it is sure enough."""
    classes = class_places(scored, label, "probs", classes)
    best = scored.select(key, class_at(argmax_index("probs"), classes).alias("_best"), F.array_max("probs").alias("_sure"))
    changes = join_small(best, issues.select(key), key)
    if min_confidence is not None:
        changes = changes.filter(F.col("_sure") >= min_confidence)
    return update_listed(df, changes, key, label, "_best")


def wrong_class(label: str, classes: list, u: Column) -> Column:
    """The class at place floor(u * (K-1)) among all but the row's own."""
    own = F.col(label)
    others = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c != own)
    return F.element_at(others, (F.floor(u * F.size(others)) + 1).cast("int"))


def inject_label_noise(
    df: DataFrame,
    key: str,
    label: str,
    fraction: float = 0.10,
    seed: int = SEED,
    split: str = "split",
    out: str = "is_synthetically_noisy",
) -> DataFrame:
    """Give floor(n_train * fraction) train rows another class and mark them.

    Without a split column, every row counts as train.
    """
    classes = class_list(df, label)
    if len(classes) < 2:
        raise ValueError("noise needs at least two classes")
    is_train = F.col(split) == "train" if split in df.columns else F.lit(True)
    quota = F.when(F.col("_train"), F.floor(F.col("n") * F.lit(fraction))).otherwise(0)
    banded = rank_band(
        df.withColumn("_train", F.coalesce(is_train, F.lit(False))),
        random_order(key, "noise", seed),
        lambda sizes: sizes.withColumn("bounds", F.array(quota)),
        ["_train"],
        "_band",
    )
    flipped = wrong_class(label, classes, key_uniform(key, "noise class", seed))
    return (
        banded.withColumn(out, F.col("_band") == 0)
        .withColumn(label, F.when(F.col(out), flipped).otherwise(F.col(label)))
        .drop("_band", "_train")
    )


def score_detector(df: DataFrame, flagged: str, truth: str) -> DataFrame:
    """Counts, precision and recall of a detector; undefined ratios are 0."""
    f, t = F.col(flagged), F.col(truth)
    counts = df.agg(
        F.count_if(t).alias("injected"),
        F.count_if(f).alias("flagged"),
        F.count_if(f & t).alias("tp"),
        F.count_if(f & ~t).alias("fp"),
        F.count_if(~f & t).alias("fn"),
    )
    ratio = lambda other: F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(0.0))
    return counts.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))
