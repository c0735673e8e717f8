"""Whole curation steps, composed from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.keyed import SEED
from tamis.operators import audit, cleaning
from tamis.operators.acquire import active_learning_loop
from tamis.operators.balance import append_plan, augmentation_plan
from tamis.operators.experiments import comparison_table, error_bars, learning_curve, run_condition, run_summary, significance_test
from tamis.operators.images import NORM_SAMPLE, normalization_stats
from tamis.operators.label_noise import (
    class_list,
    inject_label_noise,
    label_issues,
    oos_probabilities,
    remove_flagged,
    score_detector,
)
from tamis.operators.splits import sample_n, sample_per_class, seed_pool_split, split_crosstab, stratified_split
from tamis.session import join_small, materialise, small_rows
from tamis.sources.files import decodable, read_files, read_pixels, scan_categories, scan_class_dirs
from tamis.sources.manifests import read_manifest, write_manifest, write_norm_stats
from tamis.sources.runs import append_runs, read_runs, write_comparison


def class_map(classes: Sequence[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(classes)}


# --- building manifests ------------------------------------------------------------


def validate_folder(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Faulty files, members of duplicate groups and a summary; files are hashed and decoded once."""
    inspected = materialise(cleaning.inspect_files(read_files(spark, root), decoded=decodable(spark, root)))
    return {
        "faulty": cleaning.faulty_files(inspected),
        "duplicates": cleaning.duplicate_members(inspected.select("path", "content_md5"), "path"),
        "summary": cleaning.validation_summary(inspected),
    }


def baseline_manifest(spark: SparkSession, root: str, classes: Sequence[str], path: str) -> DataFrame:
    """Class folders, split, written. The folders are listed once."""
    manifest = materialise(scan_class_dirs(spark, root, class_map(classes)))
    write_manifest(stratified_split(manifest, "path", "label"), path)
    return read_manifest(spark, path)


def category_manifest(
    spark: SparkSession, root: str, categories: list[str], path: str
) -> tuple[DataFrame, DataFrame]:
    """Inspection layout of several categories, split within each, written; with its crosstab."""
    manifest = materialise(scan_categories(spark, root, categories))
    parted = stratified_split(manifest, "path", "label", within=["category"])
    write_manifest(parted, path)
    stored = read_manifest(spark, path, "path string, label int, defect_type string, category string, mask_path string, split string")
    return stored, split_crosstab(stored, "category")


def cleaned_manifest(spark: SparkSession, root: str, classes: Sequence[str], path: str) -> DataFrame:
    """Class folders without faulty files and surplus copies, split, written."""
    manifest = scan_class_dirs(spark, root, class_map(classes))
    clean = materialise(cleaning.clean_manifest(read_files(spark, root), manifest, decoded=decodable(spark, root)))
    write_manifest(stratified_split(clean, "path", "label"), path)
    return read_manifest(spark, path)


def clean_within_split(files: DataFrame, parted: DataFrame, key: str = "path", decoded: DataFrame | None = None) -> DataFrame:
    """Clean a manifest that is already split, so that all conditions share their test rows."""
    return cleaning.clean_manifest(files, parted, key, decoded=decoded)


def preprocessing_stats(
    spark: SparkSession, manifest: DataFrame, path: str, sample: int = NORM_SAMPLE
) -> None:
    """Normalisation statistics of a sample of train images, written as JSON.

    Only the sampled files are opened.
    """
    train = cleaning.select_split(manifest, "train").select("path")
    names = [r.path for r in small_rows(sample_n(train, "path", sample), "sampled files")]
    write_norm_stats(normalization_stats(read_pixels(spark, names), "path", sample=None), path)


def explore(manifest: DataFrame, key: str, label: str, category: str | None = None, kind: str | None = None) -> dict[str, DataFrame]:
    """The tables behind an exploratory report."""
    tables = {
        "audit": audit.label_audit(manifest, label),
        "distribution": audit.class_distribution(manifest, label),
        "grid": sample_per_class(manifest, key, label),
    }
    if category is not None:
        tables["audit_by_category"] = audit.label_audit_by(manifest, label, category)
        tables["distribution_by_category"] = audit.breakdown(manifest, category, label)
        if kind is not None:
            tables["defects"] = audit.breakdown(manifest.filter(F.col(label) == 1), category, kind)
    return tables


# --- label noise -------------------------------------------------------------------


def train_issues(manifest: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Likely wrong labels among the train rows."""
    train = manifest.filter(F.col("split") == "train")
    classes = class_list(train, label)
    scored = materialise(oos_probabilities(train, key, label, vec, k, seed, classes))
    return label_issues(scored, key, label, classes=classes)


def noise_corrected(manifest: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """The manifest without the flagged train rows; val and test stay as they are."""
    return remove_flagged(manifest, train_issues(manifest, key, label, vec, k, seed), key)


def validate_detector(
    manifest: DataFrame, key: str, label: str, vec: str, fraction: float = 0.10, k: int = 5, seed: int = SEED
) -> DataFrame:
    """Inject known noise into the train rows and score the detector against it."""
    noisy = inject_label_noise(manifest, key, label, fraction, seed)
    flags = train_issues(noisy, key, label, vec, k, seed).select(key, F.lit(True).alias("flagged"))
    train = noisy.filter(F.col("split") == "train").select(key, "is_synthetically_noisy")
    marked = join_small(train, flags, key, "left").fillna(False, subset=["flagged"])
    return score_detector(marked, "flagged", "is_synthetically_noisy")


# --- improvement and comparison ----------------------------------------------------


def rebalanced(manifest: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """The train rows' rarest class raised to the size of the largest by planned copies."""
    train = manifest.filter(F.col("split") == "train")
    balance = audit.imbalance(train, label).first()
    target = train.filter(F.col(label) == balance.majority_class).count()
    plan = augmentation_plan(train, key, label, balance.minority_class, target, seed)
    # A copy has the features of its source, so that any probe can be fitted on the result.
    return append_plan(manifest, plan, key, label)


def improved_condition(manifest: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Likely wrong labels removed from the train rows, then the rarest class raised."""
    return rebalanced(materialise(noise_corrected(manifest, key, label, vec, k, seed)), key, label, seed)


def active_parts(manifest: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seed set and pool from the train rows, and the val rows."""
    marked = seed_pool_split(manifest.filter(F.col("split") == "train"), key, label)
    labeled = marked.filter("is_seed").drop("is_seed")
    pool = marked.filter("NOT is_seed").drop("is_seed")
    return labeled, pool, cleaning.select_split(manifest, "val")


def active_against_random(
    manifest: DataFrame, key: str, label: str, vec: str, n_rounds: int, batch_size: int, strategy: str = "entropy"
) -> DataFrame:
    """Learning curves of a strategy and of random picks, side by side."""
    parts = active_parts(manifest, key, label)
    active = active_learning_loop(*parts, key, label, vec, n_rounds, batch_size, strategy)
    chance = active_learning_loop(*parts, key, label, vec, n_rounds, batch_size, "random")
    return learning_curve(active, chance)


def log_condition(
    manifest: DataFrame, condition: str, key: str, label: str, vec: str, experiment: str, runs_path: str, n_runs: int = 5
) -> DataFrame:
    """Run one condition, append it to the run log, return its summary."""
    log = materialise(run_condition(manifest, condition, key, label, vec, experiment, n_runs))
    append_runs(log, runs_path)
    return run_summary(log)


def compare_conditions(spark: SparkSession, runs_path: str, experiment: str, out: str, metric: str = "test_f1") -> dict[str, DataFrame]:
    """Comparison table (written), error bars and, where both exist, the t-test of first and last condition."""
    runs = read_runs(spark, runs_path, experiment)
    result = {"table": comparison_table(runs, metric)}
    write_comparison(result["table"], out)
    result["error_bars"] = error_bars(result["table"])
    seen = {r.condition for r in result["table"].select("condition").collect()}
    if {"baseline", "dcai_improved"} <= seen:
        result["t_test"] = significance_test(runs, "baseline", "dcai_improved", metric)
    return result
