"""Confident learning, noise injection, correction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import label_noise as noise
from tamis.operators.splits import stratified_split
from tamis.plans import curation


@pytest.fixture(scope="module")
def obvious(spark):
    labels = [0, 0, 0, 1, 1, 1]
    probs = [[0.9, 0.1], [0.85, 0.15], [0.1, 0.9], [0.1, 0.9], [0.15, 0.85], [0.9, 0.1]]
    return spark.createDataFrame(list(zip(range(6), labels, probs)), "key int, label int, probs array<double>")


@pytest.fixture(scope="module")
def separable(spark):
    """Three well-separated classes, 600 rows."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(600):
        centre = np.zeros(8)
        centre[i % 3] = 1.0
        rows.append((i, i % 3, [float(x) for x in centre + draw.normal(0, 0.15, 8)]))
    return spark.createDataFrame(rows, "key bigint, label int, vec array<float>").cache()


@pytest.mark.parametrize("method", noise.PRUNE_METHODS)
@pytest.mark.parametrize("rank_by", noise.RANK_METHODS)
def test_obvious_noise_is_found(obvious, method, rank_by):
    found = noise.label_issues(obvious, "key", "label", "probs", method, rank_by).collect()
    assert {r.key for r in found} == {2, 5}
    assert sorted(r.issue_rank for r in found) == [1, 2]


def test_confident_joint_of_the_fixture(obvious):
    thresholds = {r.label: r.threshold for r in noise.class_thresholds(obvious, "label").collect()}
    assert thresholds == {0: pytest.approx(0.616666667), 1: pytest.approx(0.616666667)}
    cells = {(r.label, r.suggested): (r.n, r.quota) for r in noise.confident_joint(obvious, "label").collect()}
    assert cells == {(0, 0): (2, 2), (0, 1): (1, 1), (1, 0): (1, 1), (1, 1): (2, 2)}


def test_labels_need_not_count_from_zero(spark, obvious):
    named = obvious.withColumn("label", F.when(F.col("label") == 0, 5).otherwise(9))
    for method in noise.PRUNE_METHODS:
        found = noise.label_issues(named, "key", "label", method=method).collect()
        assert {(r.key, r.label) for r in found} == {(2, 5), (5, 9)}
    cells = {(r.label, r.suggested): r.quota for r in noise.confident_joint(named, "label").collect()}
    assert cells == {(5, 5): 2, (5, 9): 1, (9, 5): 1, (9, 9): 2}
    fixed = noise.relabel_flagged(named, noise.label_issues(named, "key", "label"), named, "key", "label")
    assert [r.label for r in fixed.orderBy("key").collect()] == [5, 5, 9, 9, 9, 5]


def test_a_class_without_rows_and_rows_without_a_label(spark):
    shape = "key int, label int, probs array<double>"
    rows = [(0, 1, [0.1, 0.8, 0.1]), (1, 1, [0.1, 0.7, 0.2]), (2, 2, [0.1, 0.1, 0.8]), (3, 2, [0.0, 0.9, 0.1]), (4, None, [0.4, 0.3, 0.3])]
    df = spark.createDataFrame(rows, shape)
    assert [r.key for r in noise.label_issues(df, "key", "label", classes=[0, 1, 2]).collect()] == [3]
    with pytest.raises(ValueError, match="name the classes"):
        noise.label_issues(df.filter("label = 1").withColumn("label", F.lit(7)), "key", "label")


def test_a_thousand_classes(spark):
    # Row i of class c is sure of c, but every tenth class's second row is sure of the next class.
    size = 1000
    base = spark.range(2 * size).select(F.col("id").alias("key"), (F.col("id") % size).cast("int").alias("label"))
    wrong = (F.col("key") >= size) & (F.col("label") % 10 == 0)
    sure = F.when(wrong, (F.col("label") + 1) % size).otherwise(F.col("label"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(j == sure, 0.9).otherwise(0.1 / (size - 1)))
    found = noise.label_issues(base.withColumn("probs", probs), "key", "label").collect()
    assert {r.key for r in found} == {size + 10 * i for i in range(100)}


def test_unknown_options_are_errors(obvious):
    with pytest.raises(ValueError):
        noise.label_issues(obvious, "key", "label", method="other")
    with pytest.raises(ValueError):
        noise.label_issues(obvious, "key", "label", rank_by="other")


def test_noise_without_split_touches_any_row(spark):
    rows = spark.createDataFrame([(f"img_{i}.png", int(i >= 50)) for i in range(100)], "path string, label int")
    noisy = noise.inject_label_noise(rows, "path", "label", 0.1)
    changed = noisy.join(rows.withColumnRenamed("label", "old"), "path")
    assert changed.filter("is_synthetically_noisy").count() == 10
    assert changed.filter("is_synthetically_noisy <> (label <> old)").count() == 0


def test_noise_touches_train_rows_only(spark):
    rows = spark.createDataFrame([(i, i % 4) for i in range(1000)], "key bigint, label int")
    parted = stratified_split(rows, "key", "label")
    noisy = noise.inject_label_noise(parted, "key", "label", 0.10)
    changed = noisy.join(rows.withColumnRenamed("label", "old"), "key")
    assert changed.filter("label <> old").count() == 70
    assert changed.filter("label <> old AND split <> 'train'").count() == 0
    # Wrong classes are spread over all the others.
    assert changed.filter("label <> old").select("label", "old").distinct().count() >= 10


def test_oos_probabilities_leave_the_own_fold_out(separable):
    scored = noise.oos_probabilities(separable, "key", "label", "vec").collect()
    assert len(scored) == 600
    rows = {r.key: r for r in separable.collect()}
    fold = {r.key: r.fold for r in scored}
    for r in scored[:5]:
        x = np.array(rows[r.key].vec, dtype=float)
        logits = []
        for c in range(3):
            others = [q.vec for q in rows.values() if q.label == c and fold[q.key] != r.fold]
            logits.append(-10.0 * ((x - np.mean(others, axis=0)) ** 2).sum())
        e = np.exp(np.array(logits) - max(logits))
        assert r.probs == pytest.approx(list(e / e.sum()), abs=1e-8)


def test_a_class_only_in_one_fold_gets_no_probability(spark):
    rows = [(i, 0 if i < 9 else 1, [float(i), 1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "key bigint, label int, vec array<float>")
    lone = noise.oos_probabilities(df, "key", "label", "vec", k=3).filter("key = 9").first()
    assert lone.probs == [1.0, 0.0]


def test_detector_finds_injected_noise(separable):
    result = curation.validate_detector(stratified_split(separable, "key", "label"), "key", "label", "vec").first()
    assert result.injected == 42
    assert result.recall > 0.9 and result.precision > 0.9


def test_logistic_probe_agrees_on_separable_data(separable):
    noisy = noise.inject_label_noise(separable, "key", "label", 0.1)
    scored = noise.oos_probabilities_logistic(noisy, "key", "label", "vec", k=3)
    found = noise.label_issues(scored, "key", "label").join(noisy.select("key", "is_synthetically_noisy"), "key")
    assert found.filter("is_synthetically_noisy").count() >= 55


def test_correction(separable):
    noisy = noise.inject_label_noise(separable, "key", "label", 0.1)
    scored = noise.oos_probabilities(noisy, "key", "label", "vec").cache()
    issues = noise.label_issues(scored, "key", "label")
    n = issues.count()
    assert noise.remove_flagged(noisy, issues, "key").count() == 600 - n
    fixed = noise.relabel_flagged(noisy, issues, scored, "key", "label")
    truth = separable.select("key", F.col("label").alias("truth"))
    assert fixed.join(truth, "key").filter("label <> truth").count() < 10
    unsure = noise.relabel_flagged(noisy, issues, scored, "key", "label", min_confidence=1.1)
    assert unsure.exceptAll(noisy).count() == 0


def test_detector_score(spark):
    rows = [(True, True)] * 80 + [(True, False)] * 9 + [(False, True)] * 10 + [(False, False)] * 810
    found = noise.score_detector(spark.createDataFrame(rows, "f boolean, t boolean"), "f", "t").first()
    assert (found.injected, found.flagged, found.tp, found.fp, found.fn) == (90, 89, 80, 9, 10)
    assert (round(found.precision, 3), round(found.recall, 3)) == (0.899, 0.889)
    nothing = noise.score_detector(spark.createDataFrame([(False, False)], "f boolean, t boolean"), "f", "t").first()
    assert (nothing.precision, nothing.recall) == (0.0, 0.0)


def test_corrected_manifest_keeps_val_and_test(separable):
    parted = stratified_split(separable, "key", "label").cache()
    corrected = curation.noise_corrected(parted, "key", "label", "vec")
    kept = parted.filter("split <> 'train'").select("key")
    assert kept.join(corrected, "key", "left_anti").count() == 0


def test_many_cells_mark_the_same_rows(spark):
    import random

    rng = random.Random(4)
    rows = []
    for key in range(400):
        draws = [rng.choice([0.1, 0.2, 0.3, rng.random()]) for _ in range(4)]
        rows.append((key, rng.randrange(4) if key else None, [d / sum(draws) for d in draws]))
    rows.append((900, 1, [0.5, float("nan"), 0.2, 0.3]))
    df = spark.createDataFrame(rows, "key int, place int, probs array<double>")
    found, suggested = noise._confident(df, "place", "probs", [0, 1, 2, 3])
    joint = noise._joint(df, "place", [0, 1, 2, 3], found, suggested)
    at_once = noise._marked_by_noise_rate(df, "key", "place", "probs", joint, found, 4, "hit")
    quotas = joint.filter("place <> suggested AND quota > 0").selectExpr("place", "suggested AS _other", "quota")
    each = noise._marked_by_many_cells(df, "key", "place", "probs", quotas, "hit")
    keys = lambda marked: {r.key for r in marked.filter("hit").collect()}
    assert keys(at_once) == keys(each) != set() and at_once.count() == len(rows)
    # and those of a plain sort
    want = set()
    for q in quotas.collect():
        mine = [(p[q._other] - p[q.place], k) for k, label, p in rows if label == q.place]
        line = sorted((g for g, _ in mine if g == g), reverse=True)[q.quota - 1]
        want |= {k for g, k in mine if g > line + 1e-9}
    assert want <= keys(at_once)
