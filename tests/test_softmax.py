"""Logistic regressions fitted together against one minimiser per replica in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import experiments, passes, softmax
from tamis.operators.splits import stratified_split


def gradient_of(x, y, w, weights, n_classes, reg):
    """Gradient of the objective at raw ``weights``, on standardised components."""
    spread = x.std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.where(spread > 0, spread, 1), 0.0)
    z = (x - x.mean(axis=0)) * scale
    logits = x @ weights[:, :-1].T + weights[:, -1]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gap = (p - np.eye(n_classes)[y]) * w[:, None] / w.sum()
    coefficients = np.divide(weights[:, :-1], scale, out=np.zeros_like(weights[:, :-1]), where=scale > 0)
    return gap.T @ z + reg * coefficients, gap.sum(axis=0)


@pytest.fixture(scope="module")
def drawn():
    draw = np.random.default_rng(5)
    y = draw.integers(0, 3, 400)
    x = draw.normal(size=(400, 4)) * [1, 20, 0.01, 0] + y[:, None] * [0.5, 1, 0.01, 0] + [3, -900, 0, 7]
    w = draw.poisson(1.0, size=(400, 2)).astype(float)
    w[y == 2, 1] = 0.0
    return x, y, w


def rows_of(spark, x, y, w):
    rows = [(i, [float(v) for v in a], int(b), [float(v) for v in c]) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "key bigint, vec array<double>, y int, w array<double>").repartition(5)


@pytest.mark.parametrize("bound", [softmax.SMALL_BYTES, 500])
def test_every_replica_is_at_its_minimum(spark, drawn, monkeypatch, bound):
    x, y, w = drawn
    rows = rows_of(spark, x, y, w).cache()
    odd = spark.createDataFrame([(900, None, 1, [1.0, 1.0]), (901, [0.0] * 4, None, [1.0, 1.0]), (902, [0.0] * 4, 7, [1.0, 1.0]), (903, [9e9] * 4, 0, [0.0, 0.0])], rows.schema)
    monkeypatch.setattr(passes, "SMALL_BYTES", bound)
    fitted = softmax.fit_replicas(rows.unionByName(odd), "vec", "y", "w", 3, tolerance=1e-6)
    assert fitted.passes < 100 and (fitted.gradient <= 1e-6).all()
    used = w.sum(axis=1) > 0
    x, y, w = x[used], y[used], w[used]
    slope, offset = gradient_of(x, y, w[:, 0], fitted.weights[0], 3, 0.01)
    assert np.abs(slope).max() < 1e-5 and np.abs(offset).max() < 1e-5
    # a class without weight in a replica gets no probability there
    both = rows.select("y", softmax.replica_probabilities(rows, "vec", fitted).alias("p")).collect()
    assert all(r.p[1][2] == 0.0 and abs(sum(r.p[1]) - 1) < 1e-9 and r.p[0][2] > 0 for r in both)


def test_models_above_the_bound_and_infinite_components_are_errors(spark, drawn, monkeypatch):
    rows = rows_of(spark, *drawn)
    broken = rows.withColumn("vec", F.transform("vec", lambda v: F.when(F.col("key") == 3, float("inf")).otherwise(v)))
    with pytest.raises(ValueError, match="infinite"):
        softmax.fit_replicas(broken, "vec", "y", "w", 3)
    monkeypatch.setattr(softmax, "SMALL_BYTES", 100)
    with pytest.raises(ValueError, match="broadcast"):
        softmax.fit_replicas(rows, "vec", "y", "w", 3)


def test_null_vectors_have_no_probabilities(spark, drawn):
    rows = rows_of(spark, *drawn)
    fitted = softmax.fit_replicas(rows, "vec", "y", "w", 3)
    asked = spark.createDataFrame([(0, None), (1, [3.0, -900.0, 0.0, 7.0]), (0, [3.0, -900.0, 0.0, 7.0])], "r int, vec array<double>")
    got = asked.select("r", softmax.replica_probabilities(asked, "vec", fitted, "r").alias("p")).collect()
    assert got[0].p is None and got[1].p[2] == 0.0 and got[2].p[2] > 0


def test_runs_are_scored_together(spark):
    draw = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in draw.normal(i % 2, 0.8, 5)]) for i in range(300)]
    manifest = stratified_split(spark.createDataFrame(rows, "key bigint, label int, vec array<float>"), "key", "label").cache()
    scored, fitted = experiments.scored_runs(manifest, "key", "label", "vec", n_runs=3)
    assert (fitted.gradient <= softmax.TOLERANCE).all()
    assert scored.groupBy("run_index").count().count() == 3
    log = experiments.run_condition(manifest, "baseline", "key", "label", "vec", "e", n_runs=3).collect()
    assert len(log) == 3 * 2 * 6 and {r.run_seed - r.run_index for r in log} == {42}
    assert all(r.value > 0.7 for r in log if r.metric.endswith("f1"))
