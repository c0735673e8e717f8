"""K-means of several starts in shared passes against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tamis.operators import acquire, clusters, passes


def table(spark, x):
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "key bigint, vec array<double>").repartition(4).cache()


@pytest.mark.parametrize("bound", [passes.SMALL_BYTES, 100])
def test_groups_are_found_and_centres_are_means(spark, monkeypatch, bound):
    draw = np.random.default_rng(1)
    truth = draw.integers(0, 5, 300)
    x = draw.normal(size=(300, 3)) * 0.1 + truth[:, None] * [3, -2, 1]
    monkeypatch.setattr(passes, "SMALL_BYTES", bound)
    rows = table(spark, x)
    best = clusters.fit_clusters(rows, "key", "vec", 5, 7, starts=4, max_iter=20)
    assert best.passes <= 21 and len(best.costs) == 4
    gaps = ((x[:, None] - best.centres[None]) ** 2).sum(axis=2)
    assert abs(gaps.min(axis=1).sum() - best.costs.min()) < 1e-6
    near = gaps.argmin(axis=1)
    for c in range(5):
        assert np.allclose(best.centres[c], x[near == c].mean(axis=0), atol=1e-3)
        assert len(set(truth[near == c])) == 1
    got = {r.key: (r.cluster, r.distance) for r in acquire.assign(rows, "key", "vec", best.centres).collect()}
    assert all(got[i][0] == near[i] and abs(got[i][1] - gaps[i].min() ** 0.5) < 1e-6 for i in range(300))


def test_fewer_texts_than_clusters_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [5.0, 5.0])], "key bigint, vec array<double>")
    got = {r.key: (r.cluster, r.distance) for r in acquire.cluster(rows, "key", "vec", k=3, restarts=2).collect()}
    assert set(got) == {1, 2, 4} and got[1] == got[2] and all(d == 0.0 for _, d in got.values())
    with pytest.raises(ValueError):
        acquire.cluster(rows.filter("key = 3"), "key", "vec", k=2)
