"""Choosing which rows to label next, and the loop around it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keyed import SEED, Order, key_uniform, random_order, score_order
from tamis.functions.vectors import (
    entropy,
    least_confidence,
    margin_uncertainty,
    squared_distance,
    vector_dim,
)
from tamis.operators.clusters import fit_clusters, nearest_centre
from tamis.operators.label_noise import centroid_probabilities, centroid_table, class_list, wrong_class
from tamis.operators.metrics import evaluate
from tamis.operators.ranking import rank_band, top_k
from tamis.session import bounded, join_small, local_table, materialise, small_rows

# Defaults of the selection strategies; fixed values.
CLUSTERS = 20
RESTARTS = 10
UNCERTAINTY_WEIGHT = 0.7
DIVERSITY_WEIGHT = 0.3
SEED_FRACTION = 0.10
MAX_ROUNDS = 12
TARGET_FRACTION = 0.60

HISTORY = "round int, n_labeled bigint, val_f1 double, val_auroc double"


def uncertainty(probs: str, method: str = "entropy") -> Column:
    if method == "entropy":
        return entropy(probs)
    if method == "least_confidence":
        return least_confidence(probs)
    if method == "margin":
        return margin_uncertainty(probs)
    raise ValueError(f"unknown uncertainty method {method!r}")


def most_uncertain(df: DataFrame, key: str, probs: str, k: int, method: str = "entropy") -> DataFrame:
    """The ``k`` most uncertain rows: (``key``, ``score``, ``pick``)."""
    scored = df.select(key, uncertainty(probs, method).alias("score"))
    return top_k(scored, score_order("score", key, descending=True), k)


# --- diversity ---------------------------------------------------------------------


def cluster(
    df: DataFrame, key: str, vec: str, k: int = CLUSTERS, seed: int = SEED, restarts: int = RESTARTS, max_iter: int = 20
) -> DataFrame:
    """K-means clusters, the best of several starts, fitted together: (``key``, ``cluster``, ``distance``).

    Null vectors have no cluster and are left out.
    """
    # Every pass reads the vectors again.
    rows = materialise(df.select(key, vec).filter(F.col(vec).isNotNull()))
    best = fit_clusters(rows, key, vec, k, seed, restarts, max_iter)
    return assign(rows, key, vec, best.centres)


def assign(rows: DataFrame, key: str, vec: str, centres: np.ndarray) -> DataFrame:
    """(``key``, ``cluster``, ``distance``) of the nearest centre."""
    listed = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    table = local_table(rows.sparkSession, listed, "cluster int, _centre array<double>")
    return (
        rows.withColumn("cluster", nearest_centre(rows, vec, centres))
        .join(F.broadcast(table), "cluster")
        .select(key, "cluster", F.sqrt(squared_distance(vec, "_centre")).alias("distance"))
    )


def cluster_representatives(df: DataFrame, key: str, k: int, cycle: bool = False) -> DataFrame:
    """Rows nearest to their cluster's centre, clusters in order: (``key``, ``cluster``, ``pick``).

    One per cluster, ``k`` at most. With ``cycle``, second nearest rows and so on follow
    until there are ``k``. ``df`` has (``key``, ``cluster``, ``distance``).
    """
    near = score_order("distance", key)
    if not cycle:
        first = F.min(F.struct(near.head.alias("head"), near.tail.alias("tail"), F.col(key).alias("key")))
        chosen = df.groupBy("cluster").agg(first["key"].alias(key)).withColumn("_turn", F.lit(1))
    else:
        sizes = small_rows(df.groupBy("cluster").agg(F.count("*").alias("n")), "clusters")
        depth, covered = 0, 0
        while covered < k and any(s.n > depth for s in sizes):
            deeper = [s.n for s in sizes if s.n > depth]
            depth = min(min(deeper), depth + max(1, math.ceil((k - covered) / len(deeper))))
            covered = sum(min(s.n, depth) for s in sizes)
        banded = rank_band(
            df.select(key, "cluster", "distance"),
            near,
            lambda s: s.withColumn("bounds", F.array(F.lit(depth).cast("bigint"))),
            ["cluster"],
            "_band",
        ).filter("_band = 0")
        # At most ``depth`` rows per cluster are left.
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(near.head, near.tail))
        chosen = banded.select(key, "cluster", place.alias("_turn"))
    by_turn = Order(F.col("_turn").cast("bigint"), F.lpad(F.hex("cluster"), 12, "0"))
    return top_k(chosen, by_turn, k).select(key, "cluster", "pick")


def hybrid(
    df: DataFrame,
    key: str,
    probs: str,
    distance: str,
    k: int,
    uncertainty_weight: float = UNCERTAINTY_WEIGHT,
    diversity_weight: float = DIVERSITY_WEIGHT,
) -> DataFrame:
    """Top ``k`` by a weighted sum of rescaled entropy and rescaled cluster distance."""
    raw = df.select(key, entropy(probs).alias("_u"), F.col(distance).alias("_d"))
    ends = raw.agg(*[f(c).alias(f"{n}{c}") for c in ("_u", "_d") for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def unit(c: str) -> Column:
        low, high = ends[f"lo{c}"], ends[f"hi{c}"]
        if low is None or high <= low:
            return F.lit(0.0)
        return (F.col(c) - F.lit(low)) / F.lit(high - low)

    score = F.lit(uncertainty_weight) * unit("_u") + F.lit(diversity_weight) * unit("_d")
    scored = raw.select(key, score.alias("score"))
    return top_k(scored, score_order("score", key, descending=True), k)


# --- labelling ---------------------------------------------------------------------


def reveal_labels(
    pool: DataFrame, picked: DataFrame, key: str, label: str, noise_rate: float = 0.0, seed: int = SEED
) -> DataFrame:
    """The picked rows of the pool; each label is wrong with probability ``noise_rate``."""
    keys = picked.select(key)
    small = bounded(keys)
    rows = pool.join(keys if small is None else F.broadcast(small), key, "left_semi")
    if noise_rate <= 0:
        return rows
    classes = class_list(pool, label)
    flip = key_uniform(key, "annotator", seed) < F.lit(noise_rate)
    other = wrong_class(label, classes, key_uniform(key, "annotator class", seed))
    return rows.withColumn(label, F.when(flip, other).otherwise(F.col(label)))


# --- the loop ----------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]


def centroid_scorer(
    labeled: DataFrame, label: str, vec: str, classes: Sequence[int], dim: int | None = None
) -> Scorer:
    """Fit the fixed probe; the scorer adds ``probs`` to any rows."""
    centroids = centroid_table(labeled, label, vec, list(classes), dim=dim)
    return lambda rows: rows.withColumn("probs", centroid_probabilities(rows, vec, centroids))


def next_batch(labeled: DataFrame, pool: DataFrame, key: str, label: str, vec: str, k: int, method: str = "entropy") -> DataFrame:
    """The ``k`` rows of the pool to label next: fit on the labelled rows, score, choose."""
    scorer = centroid_scorer(labeled, label, vec, class_list(labeled, label))
    return most_uncertain(scorer(pool), key, "probs", k, method)


def active_learning_loop(
    labeled: DataFrame,
    pool: DataFrame,
    val: DataFrame,
    key: str,
    label: str,
    vec: str,
    n_rounds: int,
    batch_size: int,
    strategy: str = "entropy",
    noise_rate: float = 0.0,
    seed: int = SEED,
    fit: Callable[[DataFrame], Scorer] | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    max_rounds: int | None = None,
    target_fraction: float | None = None,
) -> DataFrame:
    """History of a query loop: (``round``, ``n_labeled``, ``val_f1``, ``val_auroc``).

    Each round fits on the labelled rows, scores ``val``, records, picks from the pool and
    moves the picks over. ``strategy`` is an uncertainty method, ``diversity`` or ``random``.
    Only the narrow list of revealed labels is kept between rounds, checkpointed so that
    lineage and lost executors cost nothing; the wide tables are read in place.
    ``fit`` and ``score`` replace the built-in probe and metric row (f1, auroc).
    """
    spark = labeled.sparkSession
    sides = labeled.select(label, F.lit(0).alias("_side")).unionByName(pool.select(label, F.lit(1).alias("_side")))
    sizes = small_rows(sides.groupBy(label, "_side").count(), "classes")
    n_seed, n_pool = (sum(r["count"] for r in sizes if r._side == side) for side in (0, 1))
    if fit is None:
        classes, dim = sorted({r[label] for r in sizes}), vector_dim(labeled, vec)
        fit = lambda rows: centroid_scorer(rows, label, vec, classes, dim)
        score = score or (lambda scored: evaluate(scored, key, label, classes=classes if 1 in classes else None))
    score = score or (lambda scored: evaluate(scored, key, label))
    revealed: DataFrame | None = None
    n_revealed = 0
    history: list[tuple] = []
    limit = n_rounds if max_rounds is None else min(n_rounds, max_rounds)
    for number in range(limit):
        train, left = labeled, pool
        if revealed is not None:
            moved = join_small(pool.drop(label), revealed, key)
            train = labeled.unionByName(moved.select(labeled.columns))
            left = pool.join(_small_or_same(revealed.select(key)), key, "left_anti")
        scorer = fit(train)
        metrics = score(scorer(val)).first().asDict()
        history.append((number, n_seed + n_revealed, metrics["f1"], metrics.get("auroc")))
        done = n_revealed / n_pool if n_pool else 1.0
        if n_revealed >= n_pool or (target_fraction is not None and done >= target_fraction):
            break
        picked = _pick(scorer, left, key, vec, batch_size, strategy, seed + number)
        fresh = reveal_labels(left, picked, key, label, noise_rate, seed).select(key, label)
        revealed = materialise(fresh if revealed is None else revealed.unionByName(fresh))
        # Every strategy picks a full batch while the pool lasts.
        n_revealed = min(n_revealed + batch_size, n_pool)
    return local_table(spark, history, HISTORY)


def _small_or_same(df: DataFrame) -> DataFrame:
    small = bounded(df)
    return df if small is None else F.broadcast(small)


def _pick(
    scorer: Scorer, pool: DataFrame, key: str, vec: str, k: int, strategy: str, seed: int
) -> DataFrame:
    if strategy == "random":
        return top_k(pool.select(key), random_order(key, "random pick", seed), k)
    if strategy == "diversity":
        grouped = cluster(pool, key, vec, min(CLUSTERS, max(2, k)), seed, restarts=1)
        return cluster_representatives(grouped, key, k, cycle=True)
    return most_uncertain(scorer(pool), key, "probs", k, strategy)


def stop_round(
    history: DataFrame, pool_size: int, seed_size: int, max_rounds: int = MAX_ROUNDS, target: float = TARGET_FRACTION
) -> DataFrame:
    """First round at the round limit or with the target share of the pool labelled."""
    share = (F.col("n_labeled") - F.lit(seed_size)) / F.lit(float(pool_size))
    hit = (F.col("round") >= max_rounds - 1) | (share >= target)
    return history.filter(hit).agg(F.min("round").alias("stop_round"))
