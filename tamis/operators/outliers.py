"""Feature-space outliers: isolation forest and distance to the class centroid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.arrow import once
from tamis.functions.keyed import SCORE_SCALE, SEED, score_order
from tamis.functions.vectors import squared_distance, vector_sums
from tamis.operators.ranking import cuts_at_ranks
from tamis.session import join_by_size, join_small, materialise, small_rows

CONTAMINATION = 0.05
# Forest size and rows per tree of Liu, Ting & Zhou (2008); fixed values.
TREES = 100
TREE_ROWS = 256
# Centroids are wide: fewer of them are broadcast.
CENTROID_ROWS = 5_000

TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"


def upper_cut(df: DataFrame, score: str, share: float, key: str) -> float:
    """Linear-interpolated quantile of ``score`` at 1 - ``share``, exact to 9 digits."""
    n = df.count()
    if n == 0:
        raise ValueError("no scores")
    at = (n - 1) * (1.0 - share)
    low = min(math.floor(at), n - 1)
    high = min(low + 1, n - 1)
    cuts = cuts_at_ranks(df, score_order(score, key), [low + 1, high + 1], n)
    a, b = (head / SCORE_SCALE for head, _ in cuts)
    return a + (at - low) * (b - a)


def centroid_outliers(
    df: DataFrame, key: str, label: str, vec: str, contamination: float = CONTAMINATION
) -> DataFrame:
    """Add ``distance`` to the own class centroid and mark the top share as outliers."""
    sums = vector_sums(df, [label], vec)
    means = sums.select(label, F.col("n").alias("_n"), F.transform("sums", lambda s: s / F.col("n")).alias("_centroid"))
    distance = F.round(F.sqrt(squared_distance(vec, "_centroid")), 9)
    joined = join_by_size(df, means, label, "_n", max_rows=CENTROID_ROWS)
    scored = joined.withColumn("distance", distance).drop("_centroid", "_n")
    cut = upper_cut(materialise(scored.select(key, "distance")), "distance", contamination, key)
    return scored.withColumn("is_outlier", F.col("distance") > F.lit(cut))


# --- isolation forest --------------------------------------------------------------


def _expected_length(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    """One isolation tree as parallel node lists; ``feature`` -1 marks a leaf."""
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "length": []}

    def add(rows: np.ndarray, depth: int) -> int:
        here = len(nodes["feature"])
        for name, blank in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0)):
            nodes[name].append(blank)
        nodes["length"].append(depth + _expected_length(len(rows)))
        if depth >= max_depth or len(rows) <= 1:
            return here
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            return here
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= cut
        nodes["feature"][here], nodes["cut"][here] = feature, cut
        nodes["left"][here] = add(rows[goes_left], depth + 1)
        nodes["right"][here] = add(rows[~goes_left], depth + 1)
        return here

    add(points, 0)
    return nodes


def tree_samples(df: DataFrame, key: str, seed: int, trees: int, tree_rows: int) -> DataFrame:
    """(``key``, ``tree``, ``_place``): of every tree the ``tree_rows`` rows with the smallest hash
    among all rows of the table, or all rows if there are fewer.

    A scan keeps only the pairs of row and tree below a bound that leaves about twice the wanted
    ones; the bound is raised until no tree is short.
    """
    n = df.count()
    wanted = min(tree_rows, n)
    numbered = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    code = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "tree", key), 2)
    share = min(1.0, 2 * (tree_rows + 64) / max(1, n))
    while True:
        near = materialise(numbered.withColumn("_code", code).filter(F.col("_code") < F.lit(int(share * (1 << 62)))))
        filled = near.groupBy("tree").agg(F.count("*").alias("n")).agg(F.count("*").alias("trees"), F.min("n").alias("least")).first()
        if share >= 1.0 or (filled.trees == trees and filled.least >= wanted):
            break
        share = min(1.0, 2 * share)
    # A small multiple of tree_rows in each partition.
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_code", key))
    return near.withColumn("_place", place).filter(F.col("_place") <= tree_rows).drop("_code")


def isolation_trees(
    df: DataFrame, key: str, vec: str, seed: int = SEED, trees: int = TREES, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """One row per tree, grown in parallel on its own keyed sample of the whole table."""
    chosen = tree_samples(df, key, seed, trees, tree_rows)
    rows = join_small(df.select(key, vec), chosen, key).select("tree", "_place", F.col(vec).alias("_vec"))
    max_depth = math.ceil(math.log2(tree_rows))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        tree = int(group["tree"].iloc[0])
        points = np.stack(group["_vec"].to_numpy()).astype(np.float64)
        nodes = _grow(points, np.random.default_rng([seed, tree]), max_depth)
        return pd.DataFrame({"tree": [tree], **{name: [values] for name, values in nodes.items()}})

    return rows.groupBy("tree").applyInPandas(grow, TREE)


def isolation_score(df: DataFrame, vec: str, forest: DataFrame, tree_rows: int = TREE_ROWS) -> Column:
    """Anomaly score in (0, 1) from a forest of bounded size, 9 digits."""
    rows = sorted(small_rows(forest, "trees"), key=lambda r: r.tree)
    shared = df.sparkSession.sparkContext.broadcast(
        [tuple(np.asarray(r[name]) for name in ("feature", "cut", "left", "right", "length")) for r in rows]
    )
    scale = _expected_length(tree_rows)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            line = np.arange(len(x))
            depth = np.zeros(len(x))
            for feature, cut, left, right, length in shared.value:
                at = np.zeros(len(x), np.int64)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    goes_left = x[line, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                depth += length[at]
            yield pd.Series(np.round(np.exp2(-depth / len(shared.value) / scale), 9))

    return once(F.pandas_udf(score, "double"))(F.col(vec))


def feature_outliers(
    df: DataFrame,
    key: str,
    vec: str,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Add ``anomaly`` and mark the rows above its quantile at 1 - ``contamination``."""
    forest = materialise(isolation_trees(df, key, vec, seed, trees, tree_rows))
    sampled = min(tree_rows, df.select(key).limit(tree_rows).count())
    anomaly = isolation_score(df, vec, forest, sampled)
    scores = materialise(df.select(key, anomaly.alias("anomaly")))
    cut = upper_cut(scores, "anomaly", contamination, key)
    # Scoring again is cheaper than shuffling the wide rows to their scores.
    return df.withColumn("anomaly", anomaly).withColumn("is_outlier", F.col("anomaly") > F.lit(cut))
