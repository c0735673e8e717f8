"""K-means of several starts at once: every pass over the rows serves all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.arrow import once
from tamis.functions.keyed import random_order
from tamis.functions.vectors import vector_dim
from tamis.operators.passes import CELL_SUMS, added, cell_sums, few_parts, matrix
from tamis.operators.ranking import top_k
from tamis.session import SMALL_BYTES, join_small, small_rows

# Rows, drawn by key, among which the starts choose their first centres.
SEED_ROWS = 64
# Distances held at once.
CELLS = 1 << 20
# Centres that move less are at rest.
REST = 1e-4


@dataclass(frozen=True)
class Clusters:
    """``centres`` (k, dimensions) of the best start, the ``costs`` of all starts, ``passes`` over the rows."""

    centres: np.ndarray
    costs: np.ndarray
    passes: int


def _first_centres(sample: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++: rows of the sample, each drawn in proportion to its squared distance to those before."""
    chosen = [int(draw.integers(len(sample)))]
    gaps = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gaps.sum()
        chosen.append(int(draw.choice(len(sample), p=gaps / total)) if total > 0 else chosen[0])
        gaps = np.minimum(gaps, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _pass(rows: DataFrame, vec: str, centres: np.ndarray, few: bool) -> np.ndarray:
    """(starts, k, dimensions + 2): sums of the rows of every cluster, their number, their squared distances."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    starts, k, dim = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value.reshape(starts * k, dim)
        norms = (flat**2).sum(axis=1)
        out = np.zeros((starts * k, dim + 2))
        step = max(1, CELLS // (starts * k))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = matrix(batch.column(0).slice(at, step), dim)
                gaps = (norms - 2 * (x @ flat.T)).reshape(len(x), starts, k)
                near = gaps.argmin(axis=2)
                least = np.take_along_axis(gaps, near[:, :, None], axis=2)[:, :, 0] + (x**2).sum(axis=1)[:, None]
                member = np.zeros((len(x), starts * k))
                cells = near + np.arange(starts) * k
                np.put_along_axis(member, cells, 1.0, axis=1)
                out[:, :dim] += member.T @ x
                out[:, dim] += member.sum(axis=0)
                out[:, dim + 1] += np.bincount(cells.ravel(), np.maximum(least, 0.0).ravel(), starts * k)
        yield cell_sums(out)

    found = added(rows.select(vec).mapInArrow(sums, CELL_SUMS), starts * k, dim + 2, few)
    shared.unpersist()
    return found.reshape(starts, k, dim + 2)


def fit_clusters(rows: DataFrame, key: str, vec: str, k: int, seed: int, starts: int, max_iter: int) -> Clusters:
    """The best of several starts after at most ``max_iter`` rounds.

    The starts differ in their first centres, which are chosen among ``SEED_ROWS`` x k rows
    drawn by key; every later step uses all rows. A cluster that loses all rows keeps its
    centre. Pass materialised rows without null vectors; none is an error, and so are vectors
    of different lengths and centres above the broadcast bound.
    """
    dim = vector_dim(rows, vec)
    if starts * k * (dim + 2) * 8 > SMALL_BYTES:
        raise ValueError("more centres than can be broadcast")
    drawn = top_k(rows.select(key), random_order(key, "first centres", seed), SEED_ROWS * k)
    sample = small_rows(join_small(rows.select(key, vec), drawn.select(key, "pick"), key).orderBy("pick"), "first centres")
    points = np.array([r[vec] for r in sample], np.float64)
    centres = np.stack([_first_centres(points, k, np.random.default_rng([seed, s])) for s in range(starts)])
    few = few_parts(rows, starts * k, dim + 2)
    sums, passes = _pass(rows, vec, centres, few), 1
    for _ in range(max_iter):
        counts = sums[:, :, dim : dim + 1]
        moved = np.where(counts > 0, sums[:, :, :dim] / np.maximum(counts, 1), centres)
        rest = np.abs(moved - centres).max() <= REST
        centres = moved
        sums, passes = _pass(rows, vec, centres, few), passes + 1
        if rest:
            break
    costs = sums[:, :, dim + 1].sum(axis=1)
    return Clusters(centres[int(costs.argmin())], costs, passes)


def nearest_centre(df: DataFrame, vec: str, centres: np.ndarray) -> Column:
    """Place of the nearest centre, the first on ties."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        norms = (shared.value**2).sum(axis=1)
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=np.int32)
                continue
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            yield pd.Series((norms - 2 * (x @ shared.value.T)).argmin(axis=1).astype(np.int32))

    return once(F.pandas_udf(near, "int"))(F.col(vec))
