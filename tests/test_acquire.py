"""Selection strategies and the labelling loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import acquire
from tamis.operators.splits import stratified_split
from tamis.plans import curation


@pytest.fixture(scope="module")
def probs(spark):
    draw = np.random.default_rng(1)
    return spark.createDataFrame(
        [(i, [float(x) for x in draw.dirichlet([1, 1, 1])]) for i in range(200)], "key bigint, probs array<double>"
    ).cache()


@pytest.fixture(scope="module")
def classes(spark):
    """Two overlapping classes, split."""
    draw = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in draw.normal(i % 2, 0.6, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "key bigint, label int, vec array<float>")
    return stratified_split(df, "key", "label").cache()


SCORES = {
    "entropy": lambda p: -np.sum(p * np.log(p + 1e-12)),
    "least_confidence": lambda p: 1 - p.max(),
    "margin": lambda p: 1 - (np.sort(p)[-1] - np.sort(p)[-2]),
}


@pytest.mark.parametrize("method", SCORES)
def test_most_uncertain(probs, method):
    got = acquire.most_uncertain(probs, "key", "probs", 20, method).orderBy("pick").collect()
    want = sorted(((SCORES[method](np.array(r.probs)), r.key) for r in probs.collect()), reverse=True)[:20]
    assert [r.key for r in got] == [k for _, k in want]
    assert [r.score for r in got] == pytest.approx([s for s, _ in want])


def test_unknown_method(probs):
    with pytest.raises(ValueError):
        acquire.most_uncertain(probs, "key", "probs", 5, "other")


def test_ties_and_short_pools(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(10)], "key bigint, probs array<double>")
    assert acquire.most_uncertain(same, "key", "probs", 4).select("key").distinct().count() == 4
    assert acquire.most_uncertain(same, "key", "probs", 40).count() == 10


def test_representatives(spark):
    rows = [(i, i % 3, float(i)) for i in range(12)] + [(100, 7, 0.5)]
    df = spark.createDataFrame(rows, "key bigint, cluster int, distance double")
    once = acquire.cluster_representatives(df, "key", 10).orderBy("pick").collect()
    assert [(r.cluster, r.key) for r in once] == [(0, 0), (1, 1), (2, 2), (7, 100)]
    assert acquire.cluster_representatives(df, "key", 2).count() == 2
    cycled = acquire.cluster_representatives(df, "key", 9, cycle=True).orderBy("pick").collect()
    assert [r.key for r in cycled] == [0, 1, 2, 100, 3, 4, 5, 6, 7]
    assert acquire.cluster_representatives(df, "key", 99, cycle=True).count() == 13


def test_cluster(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(10 * (i % 4), 0.1, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "key bigint, vec array<float>")
    found = acquire.cluster(df, "key", "vec", 4, restarts=3)
    assert found.groupBy("cluster").count().filter("count = 20").count() == 4
    assert found.agg(F.max("distance")).first()[0] < 1


def test_hybrid_weights(spark):
    rows = [(1, [0.5, 0.5], 0.0), (2, [0.9, 0.1], 1.0), (3, [1.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "key bigint, probs array<double>, d double")
    assert acquire.hybrid(df, "key", "probs", "d", 1).first().key == 1
    assert acquire.hybrid(df, "key", "probs", "d", 1, 0.1, 0.9).first().key == 2


def test_reveal_labels(spark):
    pool = spark.createDataFrame([(i, i % 3) for i in range(1000)], "key bigint, label int")
    picked = pool.filter("key < 600")
    exact = acquire.reveal_labels(pool, picked, "key", "label")
    assert exact.count() == 600 and exact.join(pool, ["key", "label"]).count() == 600
    noisy = acquire.reveal_labels(pool, picked, "key", "label", 0.25)
    wrong = noisy.join(pool.withColumnRenamed("label", "old"), "key").filter("label <> old").count()
    assert 110 < wrong < 190


@pytest.mark.parametrize("strategy", ["entropy", "random", "diversity"])
def test_loop(classes, strategy):
    parts = curation.active_parts(classes, "key", "label")
    history = acquire.active_learning_loop(*parts, "key", "label", "vec", 3, 30, strategy).orderBy("round").collect()
    assert [(r["round"], r.n_labeled) for r in history] == [(0, 28), (1, 58), (2, 88)]
    assert all(r.val_f1 > 0.8 and r.val_auroc > 0.9 for r in history)


def test_loop_ends_with_the_pool(classes):
    labeled, pool, val = curation.active_parts(classes, "key", "label")
    few = pool.limit(25).cache()
    history = acquire.active_learning_loop(labeled, few, val, "key", "label", "vec", 9, 20).collect()
    assert [r.n_labeled for r in history] == [28, 48, 53]
    none = acquire.active_learning_loop(labeled, pool.limit(0), val, "key", "label", "vec", 9, 20).collect()
    assert [r.n_labeled for r in none] == [28]


def test_loop_stops_at_the_target(classes):
    parts = curation.active_parts(classes, "key", "label")
    history = acquire.active_learning_loop(
        *parts, "key", "label", "vec", 9, 60, max_rounds=5, target_fraction=0.4
    ).collect()
    # The pool has 252 rows: 120 are above 40 %.
    assert [r.n_labeled for r in history] == [28, 88, 148]


def test_loop_takes_other_models(classes, spark):
    seen = []

    def fit(rows):
        seen.append(rows.count())
        return lambda rows: rows.withColumn("probs", F.array(F.lit(0.4), F.lit(0.6)))

    def score(scored):
        return scored.agg(F.lit(0.5).alias("f1"), F.count("*").alias("n")).select("f1")

    parts = curation.active_parts(classes, "key", "label")
    history = acquire.active_learning_loop(*parts, "key", "label", "vec", 2, 10, fit=fit, score=score).collect()
    assert seen == [28, 38]
    assert [(r.val_f1, r.val_auroc) for r in history] == [(0.5, None), (0.5, None)]


def test_stop_round(spark):
    history = spark.createDataFrame([(i, 10 + 20 * i, 0.5, 0.5) for i in range(15)], acquire.HISTORY)
    assert acquire.stop_round(history, 100, 10).first().stop_round == 3
    assert acquire.stop_round(history, 10_000, 10).first().stop_round == 11
