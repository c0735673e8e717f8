"""Validation results, exact duplicates and the removal of listed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamis.functions.images import file_fault
from tamis.session import as_col, bounded, join_by_size, local_table, materialise

IMAGE_SUFFIX = r"\.(png|jpe?g|bmp)$"


def has_image_suffix(path: str | Column) -> Column:
    return F.lower(as_col(path)).rlike(IMAGE_SUFFIX)


def select_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split; an empty split is an error."""
    rows = df.filter(F.col(column) == split)
    if rows.isEmpty():
        raise ValueError(f"no rows for split {split!r}")
    return rows


def label_by_position(df: DataFrame, class_name: str, classes: list[str], out: str = "label") -> DataFrame:
    """Turn class names into their position in ``classes``; unknown names give NULL."""
    names = F.array(*[F.lit(c) for c in classes])
    place = F.array_position(names, F.col(class_name))
    return df.withColumn(out, F.when(place > 0, place - 1).cast("int"))


def inspect_files(files: DataFrame, key: str = "path", content: str = "content", decoded: DataFrame | None = None) -> DataFrame:
    """One pass over file bytes: (``key``, ``content_md5``, ``fault``); sound files have a NULL fault.

    With ``decoded`` (``key``, ``decoded``), a file that does not decode is faulty whatever its
    structure, and one that does may have any header, but must be whole.
    """
    looked = files.select(key, F.md5(content).alias("content_md5"), file_fault(F.col(content)).alias("fault"))
    if decoded is None:
        return looked
    partial = F.when(F.col("fault").isin("truncated", "bad checksum"), F.col("fault"))
    fault = F.when(F.col("decoded"), partial).when(~F.col("decoded"), F.coalesce("fault", F.lit("undecodable"))).otherwise(F.col("fault"))
    # Narrow rows only: names, hashes and faults.
    return looked.join(decoded, key, "left").select(key, "content_md5", fault.alias("fault"))


def faulty_files(inspected: DataFrame, key: str = "path") -> DataFrame:
    return inspected.filter("fault IS NOT NULL").select(key, F.col("fault").alias("reason"))


def content_hashes(df: DataFrame, key: str, content: str) -> DataFrame:
    """(``key``, ``content_md5``): the only part of the content that is ever shuffled."""
    return df.select(key, F.md5(content).alias("content_md5"))


def duplicate_groups(hashes: DataFrame, key: str) -> DataFrame:
    """One row per group of equal content: size and first (smallest) key. Absent content equals nothing."""
    return (
        hashes.filter("content_md5 IS NOT NULL")
        .groupBy("content_md5")
        .agg(F.count("*").alias("group_size"), F.min(key).alias("first_key"))
        .filter("group_size > 1")
    )


def duplicate_members(hashes: DataFrame, key: str, stored: bool = False) -> DataFrame:
    """Every row of a duplicate group. Groups stay rows, never arrays: one may be huge.

    The hashes are read twice and written once before, unless they are ``stored`` already.
    """
    hashes = hashes if stored else materialise(hashes)
    groups = duplicate_groups(hashes, key)
    few = bounded(groups)
    return join_by_size(hashes, materialise(groups) if few is None else few, "content_md5", "group_size").select(
        "content_md5", "group_size", key, (F.col(key) == F.col("first_key")).alias("is_first")
    )


def surplus_copies(hashes: DataFrame, key: str, stored: bool = False) -> DataFrame:
    """Keys of all but the first row of every duplicate group."""
    return duplicate_members(hashes, key, stored).filter(~F.col("is_first")).select(key)


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; the list is broadcast only after a size check."""
    keys = listed.select(key)
    small = bounded(keys)
    return df.join(keys if small is None else F.broadcast(small), key, "left_anti")


def resolve_duplicates(df: DataFrame, key: str, content: str, strategy: str = "keep_first") -> DataFrame:
    """Keep the row with the smallest key of every group of equal content."""
    if strategy != "keep_first":
        raise NotImplementedError(f"unknown duplicate strategy {strategy!r}")
    return keep_first(df, content_hashes(df, key, content), key)


def keep_first(df: DataFrame, hashes: DataFrame, key: str, stored: bool = False) -> DataFrame:
    """``df`` without the surplus copies found in ``hashes`` (``key``, ``content_md5``)."""
    return drop_listed(df, surplus_copies(hashes, key, stored), key)


def validation_summary(inspected: DataFrame) -> DataFrame:
    """One row: totals of files, faults and duplicate groups; duplicates do not count as unclean."""
    groups = (
        inspected.groupBy("content_md5")
        .agg(
            F.count("*").alias("files"),
            F.count_if(F.col("fault").isNotNull() & (F.col("fault") != "empty")).alias("corrupt"),
            F.count_if(F.col("fault") == "empty").alias("unreadable"),
        )
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return groups.agg(
        total("files").alias("total_files"),
        total("corrupt").alias("n_corrupt"),
        total("unreadable").alias("n_unreadable"),
        F.count_if((F.col("files") > 1) & F.col("content_md5").isNotNull()).alias("n_duplicate_groups"),
    ).withColumn("is_clean", (F.col("n_corrupt") + F.col("n_unreadable")) == 0)


def update_listed(df: DataFrame, changes: DataFrame, key: str, column: str, new: str) -> DataFrame:
    """Replace ``column`` by ``new`` on the rows listed in ``changes``."""
    listed = changes.select(key, F.col(new).alias("_new"))
    small = bounded(listed)
    joined = df.join(listed if small is None else F.broadcast(small), key, "left")
    return joined.withColumn(column, F.coalesce(F.col("_new"), F.col(column))).drop("_new")


def align(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Predictions or embeddings next to their manifest rows, by key."""
    return df.join(other, key)


class Funnel:
    """Row counts of the steps of a running pipeline, taken from its own execution.

    ``step`` marks a table; once one action has run over the last marked table, ``counts`` tells
    how many rows passed each mark, without another scan.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation]] = []

    def step(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{len(self._steps)} {name}")
        self._steps.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def counts(self, spark: SparkSession) -> DataFrame:
        """(step_no, step, rows_before, rows_after); the first mark is the input."""
        rows = [seen.get["rows"] for _, seen in self._steps]
        lines = [(i, name, rows[i - 1], rows[i]) for i, (name, _) in enumerate(self._steps) if i]
        return local_table(spark, lines, "step_no int, step string, rows_before bigint, rows_after bigint")


def clean_manifest(
    files: DataFrame, manifest: DataFrame, key: str = "path", content: str = "content", decoded: DataFrame | None = None, watch: Funnel | None = None
) -> DataFrame:
    """Drop faulty files, then surplus copies, from one inspection pass over the bytes.

    ``watch`` counts the rows of the manifest, without faults and without copies.
    """
    inspected = materialise(inspect_files(files, key, content, decoded))
    mark = watch.step if watch else lambda _, df: df
    sound = drop_listed(mark("manifest", manifest), faulty_files(inspected, key), key)
    hashes = inspected.select(key, "content_md5")
    return mark("without copies", keep_first(mark("without faults", sound), hashes, key, stored=True))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows before and after each cumulative filter, counted in one pass."""
    kept = F.lit(True)
    counts = [F.count("*").alias("_0")]
    for i, condition in enumerate(steps.values(), start=1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(f"_{i}"))
    lines = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"_{i - 1}").alias("rows_before"),
            F.col(f"_{i}").alias("rows_after"),
        )
        for i, name in enumerate(steps, start=1)
    ]
    return df.agg(*counts).select(F.inline(F.array(*lines)))
