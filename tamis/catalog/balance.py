"""Oversampling, augmentation plans, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import PIXEL, SAMPLES, query, rounded, samples, sql_code, sql_split, sql_uniform, table
from tamis.catalog.files import class_target, embedding_images
from tamis.catalog.noise import split_embeddings, sql_flagged, sql_probs
from tamis.operators import balance as ops
from tamis.operators.outliers import centroid_outliers, feature_outliers
from tamis.plans.curation import improved_condition, rebalanced
from tamis.session import scratch_path
from tamis.sources.manifests import write_samples
from tamis.operators.splits import stratified_split

# Class 0 of the labelled documents is the rare one; it is raised to twice its size.


def sql_draws(use: str, rows: str = "samples", key: str = "doc_id", rare: str = "0", missing: str = "(SELECT count(*) FROM source)") -> str:
    """CTEs ending in ``picked``: ``missing`` draws from the ``rare`` class of ``rows``."""
    return f"""source AS (SELECT * FROM {rows} WHERE label = {rare}),
ranked_sources AS (SELECT *, row_number() OVER (ORDER BY {sql_code(use, key)}) AS place FROM source),
draws AS (
  SELECT draw, 1 + CAST(floor({sql_uniform(use, 'draw')} * (SELECT CAST(count(*) AS DOUBLE) FROM source)) AS BIGINT) AS place
  FROM (SELECT unnest(range(0, {missing})) AS draw)),
picked AS (SELECT d.draw, r.* EXCLUDE (place) FROM draws d JOIN ranked_sources r USING (place))"""


def sql_rebalanced(manifest: str, key: str) -> str:
    """CTEs ending in ``picked``: what raises the rarest train class of ``manifest`` to the largest."""
    draws = sql_draws("augment", "train_part", key, "(SELECT min_by(label, (n, label)) FROM train_sizes)", "(SELECT max(n) - min(n) FROM train_sizes)")
    return f"""train_part AS (SELECT * FROM {manifest} WHERE split = 'train'),
train_sizes AS (SELECT label, count(*) AS n FROM train_part GROUP BY label), {draws}"""


SQL_COPY = "'aug_' || CAST(label AS VARCHAR) || '_' || CAST(draw AS VARCHAR)"


@query(
    "naive_oversample",
    f"""WITH {SAMPLES}, {sql_draws('oversample')}
SELECT doc_id, lang, label FROM samples UNION ALL SELECT doc_id, lang, label FROM picked""",
)
def naive_oversample(spark, folder):
    rows = samples(spark, folder).select("doc_id", "lang", "label")
    return ops.naive_oversample(rows, "doc_id", "label", 0, class_target(rows))


def aug(use: str) -> str:
    return sql_uniform(use, "aug_key")


SQL_PLAN = f"""WITH {SAMPLES}, {sql_draws('augment')},
named AS (SELECT 'aug_0_' || CAST(draw AS VARCHAR) AS aug_key, doc_id AS source_key FROM picked)
SELECT aug_key, source_key, CAST(0 AS INTEGER) AS label, 'train' AS split,
       {aug('hflip')} < 0.5 AS hflip, {aug('vflip')} < 0.5 AS vflip,
       CAST(CASE WHEN {aug('rotate')} < 0.5 THEN floor({aug('quarter turns')} * 4) ELSE 0 END AS INTEGER) AS rot90,
       round(CASE WHEN {aug('light')} < 0.5 THEN {aug('contrast')} * 0.3::DOUBLE - 0.15::DOUBLE ELSE 0 END, 6) AS contrast,
       round(CASE WHEN {aug('light')} < 0.5 THEN {aug('brightness')} * 0.3::DOUBLE - 0.15::DOUBLE ELSE 0 END, 6) AS brightness,
       round(CASE WHEN {aug('noise')} < 0.3::DOUBLE THEN {aug('variance')} * 15.0::DOUBLE + 5.0::DOUBLE ELSE 0 END, 6) AS noise_var
FROM named"""


@query("augmentation_plan", SQL_PLAN)
def augmentation_plan(spark, folder):
    rows = samples(spark, folder).select("doc_id", "label")
    plan = ops.augmentation_plan(rows, "doc_id", "label", 0, class_target(rows))
    return rounded(plan, "contrast", "brightness", "noise_var")


@query(
    "augmented_manifest",
    f"""WITH {SAMPLES}, {sql_draws('augment')}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, lang, CAST(NULL AS VARCHAR) AS split FROM samples
UNION ALL SELECT 'aug_0_' || CAST(draw AS VARCHAR), 0, lang, 'train' FROM picked""",
)
def augmented_manifest(spark, folder):
    rows = samples(spark, folder).select("doc_id", "label", "lang").withColumn("split", F.lit(None).cast("string"))
    plan = ops.augmentation_plan(rows, "doc_id", "label", 0, class_target(rows))
    return ops.append_plan(rows, plan, "doc_id", "label")


@query(
    "rebalanced_manifest",
    f"""WITH {SAMPLES}, {sql_split('samples')}, {sql_rebalanced('parted', 'doc_id')}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, lang, split FROM parted
UNION ALL SELECT {SQL_COPY}, label, lang, 'train' FROM picked""",
)
def rebalanced_manifest(spark, folder):
    manifest = stratified_split(samples(spark, folder).select("doc_id", "label", "lang"), "doc_id", "label")
    return rebalanced(manifest, "doc_id", "label")


@query(
    "improved_condition",
    f"""WITH {sql_split('embeddings', 'vec_id')}, train_rows AS (SELECT * FROM parted WHERE split = 'train'),
{sql_probs('train_rows')}, {sql_flagged('pbnr')},
corrected AS (SELECT * FROM parted WHERE vec_id NOT IN (SELECT vec_id FROM flagged)), {sql_rebalanced('corrected', 'vec_id')}
SELECT CAST(vec_id AS VARCHAR) AS vec_id, label, split, round(CAST(embedding[1] AS DOUBLE), 6) AS first_feature FROM corrected
UNION ALL SELECT {SQL_COPY}, label, 'train', round(CAST(embedding[1] AS DOUBLE), 6) FROM picked""",
)
def improved(spark, folder):
    manifest = improved_condition(split_embeddings(spark, folder), "vec_id", "label", "embedding")
    return rounded(manifest.withColumn("first_feature", F.col("embedding")[0].cast("double")).drop("embedding"), "first_feature")


@query("apply_augmentation")
def apply_augmentation(spark, folder):
    images = embedding_images(spark, folder)
    plan = ops.augmentation_plan(images, "vec_id", "label", 0, class_target(images))
    rendered = ops.apply_augmentation(images, plan, "vec_id")
    return rendered.select("aug_key", "height", "width", "nChannels", F.md5("data").alias("data_md5"))


# Every copy without noise, at its own size: the source pixel of each place is found by undoing
# the quarter turns, then the flips; a grey value is written three times.
SQL_COPIES = f"""WITH {sql_draws('augment', 'embeddings', 'vec_id')},
named AS (SELECT 'aug_0_' || CAST(draw AS VARCHAR) AS aug_key, embedding FROM picked),
plan AS (
  SELECT aug_key, embedding, {aug('hflip')} < 0.5 AS hflip, {aug('vflip')} < 0.5 AS vflip,
         CASE WHEN {aug('rotate')} < 0.5 THEN CAST(floor({aug('quarter turns')} * 4) AS INTEGER) ELSE 0 END AS turns,
         CASE WHEN {aug('light')} < 0.5 THEN {aug('contrast')} * 0.3::DOUBLE - 0.15::DOUBLE ELSE 0 END AS contrast,
         CASE WHEN {aug('light')} < 0.5 THEN {aug('brightness')} * 0.3::DOUBLE - 0.15::DOUBLE ELSE 0 END AS brightness
  FROM named WHERE {aug('noise')} >= 0.3::DOUBLE),
turned AS (
  SELECT *, CASE turns WHEN 0 THEN i WHEN 1 THEN j WHEN 2 THEN 7 - i ELSE 7 - j END AS a,
         CASE turns WHEN 0 THEN j WHEN 1 THEN 7 - i WHEN 2 THEN 7 - j ELSE i END AS b
  FROM plan, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)),
sources AS (
  SELECT aug_key, i, j, contrast, brightness,
         embedding[1 + 8 * (CASE WHEN vflip THEN 7 - a ELSE a END) + (CASE WHEN hflip THEN 7 - b ELSE b END)] AS x
  FROM turned),
lit AS (
  SELECT aug_key, i, j, CAST(round_even(least(255, greatest(0, {PIXEL} * (1.0::DOUBLE + contrast) + brightness * 255.0::DOUBLE)), 0) AS INTEGER) AS v FROM sources)
SELECT aug_key, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(3 AS INTEGER) AS "nChannels",
       string_agg(repeat(printf('%02X', v), 3), '' ORDER BY i, j) AS pixels
FROM lit GROUP BY aug_key"""


def plain_copies(spark, folder):
    """The planned copies without noise, at the size of their sources."""
    images = embedding_images(spark, folder)
    plan = ops.augmentation_plan(images, "vec_id", "label", 0, class_target(images))
    return ops.apply_augmentation(images, plan.filter("noise_var = 0"), "vec_id", size=(8, 8))


def as_hex(rows):
    return rows.select("aug_key", "height", "width", "nChannels", F.hex("data").alias("pixels"))


@query("apply_augmentation_exact", SQL_COPIES)
def apply_augmentation_exact(spark, folder):
    return as_hex(plain_copies(spark, folder))


@query("augmented_image_round_trip_exact", SQL_COPIES)
def augmented_image_round_trip_exact(spark, folder):
    path = scratch_path(spark, "augmented")
    write_samples(plain_copies(spark, folder), path)
    return as_hex(spark.read.parquet(path))


@query("feature_outliers")
def isolation_forest(spark, folder):
    flagged = feature_outliers(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(flagged.select("vec_id", "anomaly", "is_outlier"), "anomaly")


@query(
    "feature_outliers_check",
    """SELECT count(*) AS scored, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS most_flagged,
       true AS flags_some, true AS flags_no_more, true AS flags_the_highest, true AS in_range FROM embeddings""",
)
def isolation_forest_check(spark, folder):
    """What must hold of any forest: every row scored, and the flagged ones those above all others."""
    flagged = feature_outliers(table(spark, folder, "embeddings"), "vec_id", "embedding")
    n = F.count("*")
    hits = F.count_if("is_outlier")
    most = F.floor(n * 0.05).cast("bigint")
    lowest_hit, highest_other = F.min(F.when(F.col("is_outlier"), F.col("anomaly"))), F.max(F.when(~F.col("is_outlier"), F.col("anomaly")))
    return flagged.agg(
        n.alias("scored"),
        most.alias("most_flagged"),
        (hits > 0).alias("flags_some"),
        (hits <= most + 1).alias("flags_no_more"),
        (lowest_hit > highest_other).alias("flags_the_highest"),
        ((F.min("anomaly") > 0) & (F.max("anomaly") < 1)).alias("in_range"),
    )


@query("pixel_feature_outliers")
def pixel_feature_outliers(spark, folder):
    """The same on cheap pixel statistics instead of embeddings."""
    from tamis.operators.images import pixel_stats

    stats = pixel_stats(embedding_images(spark, folder), "vec_id")
    features = F.array(*[F.col(c).cast("float") for c in ("mean", "std", "min", "max")])
    flagged = feature_outliers(stats.select("vec_id", features.alias("features")), "vec_id", "features")
    return rounded(flagged.select("vec_id", "anomaly", "is_outlier"), "anomaly")


@query(
    "centroid_outliers",
    """WITH components AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM embeddings),
centres AS (SELECT label, dim, avg(x) AS c FROM components GROUP BY label, dim),
distances AS (
  SELECT vec_id, label, round(sqrt(sum((x - c) * (x - c))), 9) AS distance
  FROM components JOIN centres USING (label, dim) GROUP BY vec_id, label)
SELECT vec_id, label, round(distance, 6) AS distance,
       distance > (SELECT quantile_cont(distance, 0.95) FROM distances) AS is_outlier FROM distances""",
)
def centroid_distance_outliers(spark, folder):
    flagged = centroid_outliers(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")
    return rounded(flagged.select("vec_id", "label", "distance", "is_outlier"), "distance")
