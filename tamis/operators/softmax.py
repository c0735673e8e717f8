"""Multinomial logistic regression of many replicas at once.

Replicas (bootstrap runs, folds) share the rows and differ in their weights alone. A pass over
the rows sums the loss and the gradient of all replicas, one matrix product per Arrow batch;
the sums are combined in Spark. The steps of the replicas, by L-BFGS, are taken in lockstep:
a replica that has to shorten its step does so in the same pass in which others go on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.arrow import once
from tamis.functions.vectors import vector_dim, vector_sums
from tamis.operators.passes import CELL_SUMS, added, cell_sums, few_parts, matrix
from tamis.session import SMALL_BYTES, small_rows

# Pairs of steps that a replica remembers.
MEMORY = 10
# Logits held at once.
CELLS = 1 << 20
# A step must lower the loss by this share of what its slope promises.
ENOUGH = 1e-4
# Largest component of the gradient of the mean loss at which a fit ends.
TOLERANCE = 1e-5
# Below this length of a step the loss does not fall any more in double precision.
LEAST_STEP = 1e-9


@dataclass(frozen=True)
class Fitted:
    """``weights`` (replicas, classes, dimensions + 1) of the raw vectors, the intercept last;
    -inf for a class without weight. ``gradient``: its largest component per replica at the
    end, on the standardised vectors. ``passes`` over the rows."""

    weights: np.ndarray
    gradient: np.ndarray
    passes: int


class _Descent:
    """L-BFGS of one replica: where it stands, and the point to evaluate next."""

    def __init__(self, size: int):
        self.trial = self.point = np.zeros(size)
        self.value, self.slope = np.inf, None
        self.pairs: deque = deque(maxlen=MEMORY)
        self.step, self.stalled = 1.0, False

    def take(self, value: float, slope: np.ndarray) -> None:
        """Use loss and gradient at ``trial``; choose the next one."""
        if self.slope is not None:
            if not value <= self.value + ENOUGH * self.step * (self.slope @ self.direction):
                self.step /= 2
                self.stalled = self.step < LEAST_STEP
                self.trial = self.point + self.step * self.direction
                return
            moved, turned = self.trial - self.point, slope - self.slope
            if moved @ turned > 1e-12 * (turned @ turned):
                self.pairs.append((moved, turned))
        self.point, self.value, self.slope = self.trial, value, slope
        self.direction = -self._scaled(slope)
        self.step = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(slope)))
        self.trial = self.point + self.step * self.direction

    def _scaled(self, slope: np.ndarray) -> np.ndarray:
        """The inverse Hessian, as the remembered steps show it, times the gradient."""
        q, shares = slope.copy(), []
        for moved, turned in reversed(self.pairs):
            shares.append((moved @ q) / (moved @ turned))
            q -= shares[-1] * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            q *= (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(shares)):
            q += (share - (turned @ q) / (moved @ turned)) * moved
        return q

    def ended(self, tolerance: float) -> bool:
        return self.stalled or (self.slope is not None and np.abs(self.slope).max() <= tolerance)


def _pass(rows: DataFrame, vec: str, place: str, weights: str, points: np.ndarray, closed: np.ndarray, middle: np.ndarray, scale: np.ndarray, few: bool) -> np.ndarray:
    """(replicas, classes, dimensions + 2): sums of the gradient, the intercept's and the loss, the latter at class 0."""
    shared = rows.sparkSession.sparkContext.broadcast((points, closed, middle, scale))
    n_fits, n_classes, width = points.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shut, mean, factor = shared.value
        flat = at.reshape(n_fits * n_classes, width).T
        bias = np.where(shut, -np.inf, 0.0)
        slope, loss = np.zeros((n_fits * n_classes, width)), np.zeros(n_fits)
        step = max(1, CELLS // (n_fits * n_classes))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                n = part.num_rows
                x = np.ones((n, width))
                x[:, :-1] = (matrix(part.column(0), width - 1) - mean) * factor
                y = part.column(1).to_numpy()
                w = matrix(part.column(2), n_fits)
                z = (x @ flat).reshape(n, n_fits, n_classes) + bias
                z -= z.max(axis=2, keepdims=True)
                own = z[np.arange(n), :, y]
                np.exp(z, out=z)
                total = z.sum(axis=2)
                loss += np.where(w > 0, w * (np.log(total) - np.where(w > 0, own, 0.0)), 0.0).sum(axis=0)
                z /= total[:, :, None]
                z[np.arange(n), :, y] -= 1.0
                z *= w[:, :, None]
                slope += z.reshape(n, -1).T @ x
        out = np.zeros((n_fits, n_classes, width + 1))
        out[:, :, :-1] = slope.reshape(n_fits, n_classes, width)
        out[:, 0, -1] = loss
        yield cell_sums(out.reshape(n_fits * n_classes, width + 1))

    parts = rows.select(vec, place, weights).mapInArrow(sums, CELL_SUMS)
    out = added(parts, n_fits * n_classes, width + 1, few)
    shared.unpersist()
    return out.reshape(n_fits, n_classes, width + 1)


def fit_replicas(
    rows: DataFrame, vec: str, place: str, weights: str, n_classes: int, reg: float = 0.01, max_passes: int = 200, tolerance: float = TOLERANCE
) -> Fitted:
    """Minimise, per replica, mean loss + reg/2 x squared coefficients of the standardised vectors.

    ``place`` is the class's place (from 0), ``weights`` an array with a weight for each
    replica. Every pass reads ``rows``: pass materialised ones. Rows whose vector, place or
    weights are null, and rows without any weight, take no part. Intercepts are not
    regularised. A replica without rows keeps zero weights; NaN or infinite components and
    models above the broadcast bound are errors.
    """
    rows = rows.filter(F.col(vec).isNotNull() & F.exists(weights, lambda w: w > 0)).filter(F.col(place).between(0, n_classes - 1))
    dim = vector_dim(rows, vec)
    n_fits = rows.select(F.size(weights).alias("n")).first().n
    if n_fits * n_classes * (dim + 1) * 8 > SMALL_BYTES:
        raise ValueError("more classes and dimensions than a model can be broadcast with")
    moments = vector_sums(rows, [], vec, squares=True, dim=dim).first()
    middle = np.array(moments.sums, np.float64) / moments.n
    spread = np.sqrt(np.maximum(0.0, np.array(moments.squares, np.float64) / moments.n - middle**2))
    if not np.isfinite(spread).all():
        raise ValueError("vectors with NaN or infinite components")
    # a component that hardly varies carries nothing
    scale = np.where(spread > 1e-9 * (1 + np.abs(middle)), 1 / np.where(spread > 0, spread, 1), 0.0)
    mass = np.zeros((n_fits, n_classes))
    by_class = rows.groupBy(place).agg(*[F.sum(F.get(weights, F.lit(i))).alias(f"w{i}") for i in range(n_fits)])
    for row in small_rows(by_class, "classes"):
        mass[:, row[place]] = row[1:]
    closed = (mass <= 0) & (mass.sum(axis=1) > 0)[:, None]
    totals = np.maximum(mass.sum(axis=1), 1e-300)
    fits = [_Descent(n_classes * (dim + 1)) for _ in range(n_fits)]
    shape, passes = (n_classes, dim + 1), 0
    few = few_parts(rows, n_fits * n_classes, dim + 2)
    while passes < max_passes and not all(f.ended(tolerance) for f in fits):
        points = np.stack([f.trial.reshape(shape) for f in fits])
        sums = _pass(rows, vec, place, weights, points, closed, middle, scale, few)
        passes += 1
        for i, fit in enumerate(fits):
            if fit.ended(tolerance):
                continue
            slope = sums[i, :, :-1] / totals[i]
            slope[:, :-1] += reg * points[i, :, :-1]
            value = sums[i, 0, -1] / totals[i] + reg / 2 * (points[i, :, :-1] ** 2).sum()
            fit.take(value, slope.ravel())
    found = np.stack([f.point.reshape(shape) for f in fits])
    found[:, :, :-1] *= scale
    found[:, :, -1] -= found[:, :, :-1] @ middle
    found[:, :, -1][closed] = -np.inf
    slopes = np.array([np.abs(f.slope).max() if f.slope is not None else np.inf for f in fits])
    return Fitted(found, slopes, passes)


def replica_probabilities(df: DataFrame, vec: str, fitted: Fitted, replica: str | None = None) -> Column:
    """Class probabilities by the replica that the column ``replica`` names; without it, an
    array with those of every replica, from one scan. Null for a null vector."""
    shared = df.sparkSession.sparkContext.broadcast(fitted.weights)

    def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = x @ weights[:, :-1].T + weights[:, -1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = shared.value
        for which, vectors in batches:
            out = pd.Series([None] * len(vectors), dtype=object)
            known = np.flatnonzero(vectors.notna().to_numpy())
            if len(known):
                x = np.stack(vectors.to_numpy()[known]).astype(np.float64)
                if replica is None:
                    each = np.stack([scores(x, w) for w in weights], axis=1)
                    out.iloc[known] = pd.Series([list(one) for one in each], index=known)
                else:
                    chosen = which.to_numpy()[known].astype(int)
                    for i in np.unique(chosen):
                        mine = known[chosen == i]
                        out.iloc[mine] = pd.Series(list(scores(x[chosen == i], weights[i])), index=mine)
            yield out

    shape = "array<array<double>>" if replica is None else "array<double>"
    return once(F.pandas_udf(probabilities, shape))(F.lit(0) if replica is None else F.col(replica), F.col(vec))
