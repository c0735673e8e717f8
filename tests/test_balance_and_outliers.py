"""Oversampling, rebalancing, outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import balance, outliers
from tamis.operators.splits import stratified_split
from tamis.plans import curation
from tamis.session import join_wanted


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, int(i >= 90), f"t{i}") for i in range(100)], "key bigint, label int, text string")


@pytest.mark.parametrize("copies_per_task", [100_000, 1])
def test_oversample(rows, monkeypatch, copies_per_task):
    monkeypatch.setattr(balance, "COPIES_PER_TASK", copies_per_task)
    more = balance.naive_oversample(rows, "key", "label", 1, 60)
    assert more.count() == 150
    assert more.filter("label = 1").count() == 60
    assert more.distinct().count() == 100
    assert balance.naive_oversample(rows, "key", "label", 0, 50).count() == 100


def test_oversample_of_an_absent_class_is_an_error(rows):
    with pytest.raises(ValueError):
        balance.naive_oversample(rows, "key", "label", 9, 5)


def test_plan_draws_have_the_right_shares(rows):
    plan = balance.augmentation_plan(rows, "key", "label", 1, 4010)
    assert plan.count() == 4000
    share = plan.agg(
        F.avg(F.col("hflip").cast("int")).alias("h"),
        F.avg((F.col("rot90") > 0).cast("int")).alias("r"),
        F.avg((F.col("contrast") != 0).cast("int")).alias("c"),
        F.avg((F.col("noise_var") > 0).cast("int")).alias("n"),
        F.max(F.abs("brightness")).alias("b"),
        F.min(F.when(F.col("noise_var") > 0, F.col("noise_var"))).alias("low"),
        F.max("noise_var").alias("high"),
    ).first()
    assert share.h == pytest.approx(0.5, abs=0.04) and share.c == pytest.approx(0.5, abs=0.04)
    # One in four rotations is by zero quarter turns.
    assert share.r == pytest.approx(0.375, abs=0.04) and share.n == pytest.approx(0.3, abs=0.04)
    assert share.b <= 0.15 and share.low >= 5 and share.high <= 20


def test_rebalanced_manifest(rows):
    parted = stratified_split(rows, "key", "label")
    balanced = curation.rebalanced(parted, "key", "label")
    counts = {r.label: r["count"] for r in balanced.filter("split = 'train'").groupBy("label").count().collect()}
    assert counts == {0: 63, 1: 63}
    copies = balanced.filter("key LIKE 'aug_1_%'")
    assert copies.count() == 56
    # A copy carries the other columns of a train row of its class.
    texts = parted.filter("split = 'train' AND label = 1").select("text")
    assert copies.join(texts, "text", "left_semi").count() == 56


def test_a_much_wanted_row_is_spread_by_its_own_count(spark):
    wanted = spark.range(50).select(F.concat(F.lit("c"), "id").alias("copy"), F.when(F.col("id") < 45, 0).otherwise(F.col("id")).alias("src"))
    wide = spark.createDataFrame([(i, f"row {i}") for i in range(60)], "src bigint, body string")
    joined = join_wanted(wanted, wide, "src", "copy", 10)
    assert joined.columns == ["src", "copy", "body"] and joined.count() == 50
    assert joined.filter("body = concat('row ', src)").count() == 50


def cloud(spark, n=400, strays=8):
    draw = np.random.default_rng(5)
    points = draw.normal(0, 1, (n, 4))
    points[:strays] += 12
    return spark.createDataFrame([(i, 0, [float(x) for x in p]) for i, p in enumerate(points)], "key bigint, label int, vec array<float>")


def test_isolation_forest_flags_strays(spark):
    flagged = outliers.feature_outliers(cloud(spark), "key", "vec", contamination=0.05, trees=50)
    found = {r.key for r in flagged.filter("is_outlier").collect()}
    # 0.05 of 400 rows, and the strays among them.
    assert len(found) == 20 and set(range(8)) <= found


def test_isolation_forest_does_not_depend_on_partitioning(spark):
    df = cloud(spark)
    one, many = (
        {r.key: r.anomaly for r in outliers.feature_outliers(df.repartition(n), "key", "vec", trees=10).collect()}
        for n in (1, 5)
    )
    assert one == many


@pytest.mark.parametrize("n", [0, 10, 500, 5000])
def test_every_row_can_enter_a_tree(spark, n):
    chosen = outliers.tree_samples(spark.range(n).withColumnRenamed("id", "key"), "key", 1, 30, 50).toPandas()
    assert (chosen.groupby("tree").size() == min(n, 50)).all() and chosen["tree"].nunique() == (30 if n else 0)
    assert not chosen.duplicated(["tree", "key"]).any()
    # 1500 draws of 5000 rows leave about 5000 / e^0.3 unseen; none of the thirds may be passed over.
    if n == 5000:
        assert chosen["key"].nunique() > 1200
        assert (np.histogram(chosen["key"], 3)[0] > 400).all()


def test_expected_path_length():
    # c(n) = 2 H(n-1) - 2 (n-1) / n with the harmonic number approximated.
    assert outliers._expected_length(256) == pytest.approx(10.2448, abs=1e-3)
    assert outliers._expected_length(2) == 1.0 and outliers._expected_length(1) == 0.0


def test_centroid_outliers(spark):
    flagged = outliers.centroid_outliers(cloud(spark), "key", "label", "vec", 0.02)
    assert {r.key for r in flagged.filter("is_outlier").collect()} == set(range(8))


def test_upper_cut_interpolates(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "key bigint, s double")
    assert outliers.upper_cut(df, "s", 0.05, "key") == pytest.approx(np.percentile(range(11), 95))
    assert outliers.upper_cut(df, "s", 0.0, "key") == 10.0
