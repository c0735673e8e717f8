"""Rank cuts and ranks against plain sorting, with thresholds small enough to take every path."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.functions.keyed import SCORE_SCALE, random_order, score_order
from tamis.operators import ranking
from tamis.session import bounded, join_by_size


@pytest.fixture(scope="module")
def rows(spark):
    # Group 0 holds a third of all rows; a tenth of the scores are equal.
    draw = random.Random(7)
    data = [
        (i, 0 if i % 3 == 0 else i % 11, 0.5 if draw.random() < 0.1 else draw.uniform(-3, 3)) for i in range(3000)
    ]
    df = spark.createDataFrame(data, "key bigint, grp int, score double").repartition(7)
    return df.cache()


def expected_bands(rows, order, bounds):
    by_group = {}
    for r in rows.withColumns({"_head": order.head, "_tail": order.tail}).collect():
        by_group.setdefault(r.grp, []).append(((r._head, r._tail), r.key))
    return {
        key: sum(b < rank for b in bounds)
        for members in by_group.values()
        for rank, (_, key) in enumerate(sorted(members), start=1)
    }


@pytest.mark.parametrize("by_score", [False, True])
@pytest.mark.parametrize("direct_rows", [200_000, 20, 1])
@pytest.mark.parametrize("max_groups", [1000, 3])
def test_rank_band_is_exact(rows, monkeypatch, by_score, direct_rows, max_groups):
    monkeypatch.setattr(ranking, "MAX_GROUPS", max_groups)
    order = score_order("score", "key", descending=True) if by_score else random_order("key", "test")
    bounds = [0, 5, 50, 10_000]
    got = ranking.rank_band(rows, order, ranking.fixed_bounds(*bounds), ["grp"], direct_rows=direct_rows)
    assert {r.key: r.band for r in got.collect()} == expected_bands(rows, order, bounds)


def test_rank_band_without_groups(rows):
    order = random_order("key", "test")
    got = ranking.first_in_group(rows, order, 100).select("key").collect()
    want = rows.orderBy(order.tail).limit(100).select("key").collect()
    assert {r.key for r in got} == {r.key for r in want}


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "key bigint, grp string")
    got = ranking.first_in_group(df, random_order("key", "t"), 1, ["grp"]).collect()
    assert len(got) == 2


def test_global_rank_numbers_every_row_once(rows):
    got = ranking.global_rank(rows, score_order("score", "key")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [r.score for r in got] == sorted(r.score for r in got)


@pytest.mark.parametrize("heap_rows", [10_000, 5])
def test_top_k(rows, monkeypatch, heap_rows):
    monkeypatch.setattr(ranking, "HEAP_ROWS", heap_rows)
    order = score_order("score", "key", descending=True)
    got = ranking.top_k(rows, order, 30).orderBy("pick").collect()
    assert [r.pick for r in got] == list(range(1, 31))
    best = sorted((r.score for r in rows.collect()), reverse=True)[:30]
    assert [r.score for r in got] == best
    assert ranking.top_k(rows, order, 0).count() == 0


@pytest.mark.parametrize("direct_rows", [200_000, 10, 1])
def test_cuts_at_ranks(rows, direct_rows):
    scores = sorted(r.score for r in rows.collect())
    found = ranking.cuts_at_ranks(rows, score_order("score", "key"), [1, 1500, 3000], 3000, direct_rows)
    assert [head / SCORE_SCALE for head, _ in found] == [pytest.approx(scores[i], abs=1e-9) for i in (0, 1499, 2999)]


def test_result_does_not_depend_on_partitioning(rows):
    order = random_order("key", "test")
    one, many = (
        {r.key: r.band for r in ranking.rank_band(rows.repartition(n), order, ranking.fixed_bounds(9), ["grp"]).collect()}
        for n in (1, 7)
    )
    assert one == many


def test_bounded_refuses_large_tables(rows):
    assert bounded(rows, 2999) is None
    assert bounded(rows, 3000).count() == 3000
    assert bounded(rows, 3000, max_bytes=10) is None


@pytest.mark.parametrize("hot_rows", [1_000_000, 500, 260, 10])
def test_join_by_size_with_hot_groups(rows, hot_rows):
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    got = join_by_size(rows, sizes, "grp", "n", hot_rows, max_rows=8)
    assert got.count() == 3000
    assert got.groupBy("grp").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c <> n").count() == 0


@pytest.mark.parametrize("heap", [True, False])
def test_rows_without_a_score_come_last(spark, monkeypatch, heap):
    from tamis.functions.keyed import score_order
    from tamis.operators import ranking

    monkeypatch.setattr(ranking, "HEAP_ROWS", 10_000 if heap else 0)
    scores = [None, float("nan"), None, *[i / 10 for i in range(30)]]
    df = spark.createDataFrame(list(enumerate(scores)), "id bigint, score double")
    for descending in (False, True):
        got = ranking.top_k(df, score_order("score", "id", descending), 10).orderBy("pick").collect()
        want = sorted(scores[3:], reverse=descending)[:10]
        assert [r.score for r in got] == want
    assert ranking.top_k(df, score_order("score", "id"), 32).filter("score IS NULL OR isnan(score)").count() == 2


def test_ragged_vectors_are_an_error(spark):
    from tamis.functions.vectors import vector_sums

    for rows in ([(0, [1.0, 1.0]), (1, [1.0, 1.0, 100.0])], [(0, [1.0] * 300), (1, [1.0] * 301)]):
        with pytest.raises(Exception, match="different lengths"):
            vector_sums(spark.createDataFrame(rows, "id int, v array<double>"), [], "v").collect()
