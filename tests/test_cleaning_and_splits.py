"""Removal, duplicates, splits, samples and audits."""

import pytest
from pyspark.sql import functions as F

from tamis.operators import audit, cleaning, splits
from tamis.sources.manifests import read_manifest, write_manifest


def manifest(spark, counts, category=None):
    rows = [(f"{category or ''}{label}-{i}", label, category) for label, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "path string, label int, category string")


def split_sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


# --- removal -----------------------------------------------------------------------


def test_drop_listed(spark):
    rows = spark.createDataFrame([("a.png", 0), ("b.png", 1), ("c.png", 0)], "path string, label int")
    bad = spark.createDataFrame([("b.png",)], "path string")
    assert sorted(r.path for r in cleaning.drop_listed(rows, bad, "path").collect()) == ["a.png", "c.png"]


def test_resolve_duplicates_keeps_the_first(spark):
    rows = [("a.png", 0, "x"), ("b.png", 0, "x"), ("c.png", 1, "y"), ("d.png", 1, "z")]
    df = spark.createDataFrame(rows, "path string, label int, content string")
    kept = cleaning.resolve_duplicates(df, "path", "content")
    assert sorted(r.path for r in kept.collect()) == ["a.png", "c.png", "d.png"]
    with pytest.raises(NotImplementedError):
        cleaning.resolve_duplicates(df, "path", "content", "keep_last")


def test_one_group_may_hold_most_rows(spark, monkeypatch):
    import tamis.session as session

    monkeypatch.setattr(session.join_by_size, "__defaults__", (50, 1))
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "same").otherwise((F.col("id") / 2).cast("int").cast("string")).alias("text"))
    members = cleaning.duplicate_members(cleaning.content_hashes(df, "id", "text"), "id")
    assert members.count() == 1000 and members.filter("group_size = 700").count() == 700
    assert members.filter("is_first AND group_size = 700").first().id == 0
    assert cleaning.resolve_duplicates(df, "id", "text").count() == 151


def test_absent_content_is_no_duplicate(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "")], "key int, text string")
    hashes = cleaning.content_hashes(rows, "key", "text")
    assert [(r.group_size, r.first_key) for r in cleaning.duplicate_groups(hashes, "key").collect()] == [(2, 3)]
    assert {r.key for r in cleaning.duplicate_members(hashes, "key").collect()} == {3, 4}
    assert {r.key for r in cleaning.resolve_duplicates(rows, "key", "text").collect()} == {1, 2, 3, 5}
    inspected = hashes.withColumn("fault", F.lit(None).cast("string"))
    assert cleaning.validation_summary(inspected).first().n_duplicate_groups == 1


def test_select_split(spark):
    rows = [(f"{i}.png", i % 2, "train" if i < 3 else "val") for i in range(4)]
    df = spark.createDataFrame(rows, "path string, label int, split string")
    train = cleaning.select_split(df, "train")
    assert train.count() == 3
    assert sum(r.n for r in audit.class_distribution(train, "label").collect()) == 3
    with pytest.raises(ValueError):
        cleaning.select_split(df, "test")


def test_update_listed_and_positions(spark):
    df = spark.createDataFrame([("a", "ok", 0), ("b", "bad", 1), ("c", "odd", 1)], "key string, name string, label int")
    changes = spark.createDataFrame([("b", 5)], "key string, new int")
    assert {r.key: r.label for r in cleaning.update_listed(df, changes, "key", "label", "new").collect()} == {"a": 0, "b": 5, "c": 1}
    named = cleaning.label_by_position(df.drop("label"), "name", ["ok", "bad"])
    assert {r.key: r.label for r in named.collect()} == {"a": 0, "b": 1, "c": None}


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "train"), ("b", 1, None)], "path string, label int, split string")
    for name in ("deep/m.csv", "deep/m.parquet"):
        write_manifest(df, str(tmp_path / name))
        assert sorted(read_manifest(spark, str(tmp_path / name)).collect()) == sorted(df.collect())


# --- splits ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "counts, sizes, train_per_class",
    [
        ({0: 519, 1: 781}, (909, 195, 196), (363, 546)),
        ({0: 229, 1: 63}, (204, 44, 44), None),
        ({0: 242, 1: 93}, (234, 50, 51), None),
        ({0: 361, 1: 119}, (336, 72, 72), None),
    ],
)
def test_published_split_sizes(spark, counts, sizes, train_per_class):
    parted = splits.stratified_split(manifest(spark, counts), "path", "label")
    assert tuple(split_sizes(parted)[s] for s in splits.SPLITS) == sizes
    assert parted.select("path").distinct().count() == sum(counts.values())
    if train_per_class:
        train = parted.filter("split = 'train'").groupBy("label").count().orderBy("label").collect()
        assert tuple(r["count"] for r in train) == train_per_class


def test_split_within_categories(spark):
    df = manifest(spark, {0: 229, 1: 63}, "one").union(manifest(spark, {0: 361, 1: 119}, "three"))
    table = splits.split_crosstab(
        splits.stratified_split(df, "path", "label", within=["category"]), "category"
    ).orderBy("category")
    assert [tuple(r) for r in table.collect()] == [("one", 204, 44, 44), ("three", 336, 72, 72)]


def test_split_fractions_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.stratified_split(manifest(spark, {0: 5}), "path", "label", 0.5, 0.1, 0.1)


def test_split_is_reproducible_and_seeded(spark):
    df = manifest(spark, {0: 300, 1: 100})
    one = {r.path: r.split for r in splits.stratified_split(df.repartition(1), "path", "label").collect()}
    many = {r.path: r.split for r in splits.stratified_split(df.repartition(7), "path", "label").collect()}
    other = {r.path: r.split for r in splits.stratified_split(df, "path", "label", seed=7).collect()}
    assert one == many and one != other


def test_kfold_is_balanced(spark):
    folds = splits.stratified_kfold(manifest(spark, {0: 52, 1: 23}), "path", "label", 5)
    sizes = folds.groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes if r.label == 0) == [10, 10, 10, 11, 11]
    assert sorted(r["count"] for r in sizes if r.label == 1) == [4, 4, 5, 5, 5]
    assert {r.fold for r in sizes} == set(range(5))


def test_samples(spark):
    df = manifest(spark, {0: 50, 1: 3})
    assert splits.sample_n(df, "path", 20).select("path").distinct().count() == 20
    assert splits.sample_n(df, "path", 500).count() == 53
    grid = splits.sample_per_class(df, "path", "label", 4).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in grid} == {0: 4, 1: 3}
    draws = splits.sample_with_replacement(df.filter("label = 1"), "path", 3000)
    per_key = draws.groupBy("path").count().collect()
    assert sum(r["count"] for r in per_key) == 3000 and all(900 < r["count"] < 1100 for r in per_key)
    assert splits.sample_with_replacement(df, "path", 0).count() == 0


def test_seed_pool(spark):
    marked = splits.seed_pool_split(manifest(spark, {0: 70, 1: 30}), "path", "label")
    assert {r.label: r["count"] for r in marked.filter("is_seed").groupBy("label").count().collect()} == {0: 7, 1: 3}


# --- audits ------------------------------------------------------------------------


def test_imbalance_of_published_counts(spark):
    df = manifest(spark, {0: 519, 1: 781})
    found = audit.imbalance(df, "label").first()
    assert (found.majority_class, found.minority_class, round(found.ratio, 2)) == (1, 0, 1.50)
    report = audit.label_audit(df, "label").first()
    assert report.n_samples == 1300 and report.class_counts == {0: 519, 1: 781}
    tie = audit.imbalance(manifest(spark, {2: 5, 1: 5}), "label").first()
    assert (tie.majority_class, tie.minority_class) == (1, 1)


def test_audit_by_category(spark):
    df = manifest(spark, {0: 229, 1: 63}, "one")
    df = df.union(manifest(spark, {0: 242, 1: 93}, "two")).union(manifest(spark, {0: 361, 1: 119}, "three"))
    ratios = {r.category: round(r.imbalance_ratio, 2) for r in audit.label_audit_by(df, "label", "category").collect()}
    assert ratios == {None: 3.03, "one": 3.63, "two": 2.60, "three": 3.03}


def test_kappa(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    found = audit.cohen_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert found.kappa == pytest.approx(0.4)
    assert audit.cohen_kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first().kappa is None


@pytest.mark.parametrize("wide_dim", [256, 1])
def test_vector_stats_on_both_paths(spark, monkeypatch, wide_dim):
    from tamis.functions import vectors

    monkeypatch.setattr(vectors, "WIDE_DIM", wide_dim)
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "v array<float>")
    stats = [tuple(r) for r in audit.vector_stats(df, "v").orderBy("dim").collect()]
    assert stats == [(0, 2.0, 1.0), (1, 2.0, 0.0)]


def test_flagged_share(spark):
    found = audit.flagged_share(spark.range(10), spark.range(3), "id").first()
    assert (found.n_samples, found.n_flagged, found.flagged_fraction) == (10, 3, pytest.approx(0.3))


def test_steps_are_counted_while_they_run(spark):
    watch = cleaning.Funnel()
    files = spark.createDataFrame([(1, b"BM" + (27).to_bytes(4, "little") + bytes(21)), (2, b""), (3, b"BM" + (27).to_bytes(4, "little") + bytes(21)), (4, b"no")], "key int, content binary")
    manifest = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5)], "key int, label int")
    clean = cleaning.clean_manifest(files, manifest, "key", watch=watch)
    last = watch.step("odd", clean.filter("label = 1"))
    assert {r.key for r in last.collect()} == {1, 5}
    counted = [(r.step_no, r.step, r.rows_before, r.rows_after) for r in watch.counts(spark).orderBy("step_no").collect()]
    assert counted == [(1, "without faults", 5, 3), (2, "without copies", 3, 2), (3, "odd", 2, 2)]


def test_merged_sketches_count_like_one(spark):
    rows = spark.range(6000).selectExpr("id % 3 AS load", "IF(id % 2 = 0, 'a', 'b') AS category", "id % 4000 AS kind")
    rows = rows.unionByName(spark.sql("SELECT 0L AS load, 'none' AS category, CAST(NULL AS BIGINT) AS kind"))
    parts = audit.kind_sketches(rows, ["load", "category"], "kind")
    whole = {r.category: r.n_kinds for r in audit.sketched_kinds(audit.kind_sketches(rows, ["category"], "kind")).collect()}
    merged = {r.category: r.n_kinds for r in audit.sketched_kinds(audit.merge_sketches(parts, ["category"])).collect()}
    assert whole["none"] == merged["none"] == 0
    for found in (whole, merged):
        assert all(abs(found[c] - 2000) <= 4 * audit.sketch_error() * 2000 for c in "ab")
