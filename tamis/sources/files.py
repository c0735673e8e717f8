"""Image folders as tables, listed in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamis.operators.cleaning import has_image_suffix
from tamis.session import local_table

EXPECTED_FILES = 6000
# The image suffixes in any case, so that other files are dropped at the listing.
IMAGE_GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}"
LISTING = "path string, length bigint"
# Names in one batch of a listing.
BATCH_NAMES = 10_000


def store_of(root: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a folder, the folder's path there, and what Spark writes before such paths."""
    if re.match(r"/|file:", root):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", root).rstrip("/") or "/", "file:"
    store, path = fs.FileSystem.from_uri(root)
    name = re.match(r"(\w+)://([^/]*)", root)
    inside = path.startswith(name[2] + "/")
    return store, path.rstrip("/"), f"{name[1]}://" if inside else f"{name[1]}://{name[2]}"


def _visible(path: str) -> bool:
    """Spark leaves out names that begin with a dot or an underscore."""
    return not path.rsplit("/", 1)[-1].startswith((".", "_"))


class FolderListing(DataSource):
    """Names and lengths of all files below ``root``, empty ones included.

    The driver lists the folders directly below the root; each of them is listed by a task.
    """

    @classmethod
    def name(cls) -> str:
        return "tamis_folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["root"])


class FolderReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        store, path, _ = store_of(self.root)
        found = store.get_file_info(fs.FileSelector(path))
        folders = sorted(i.path for i in found if i.type == fs.FileType.Directory and _visible(i.path))
        # the first part is for the files of the root itself
        return [InputPartition((path, False)), *(InputPartition((f, True)) for f in folders)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        folder, deep = partition.value
        store, _, prefix = store_of(self.root)
        names, sizes = [], []
        waiting = [folder]
        while waiting:
            for info in store.get_file_info(fs.FileSelector(waiting.pop())):
                if not _visible(info.path):
                    continue
                if info.type == fs.FileType.Directory and deep:
                    waiting.append(info.path)
                elif info.type == fs.FileType.File:
                    names.append(prefix + info.path)
                    sizes.append(info.size)
            while len(names) >= BATCH_NAMES or (names and not waiting):
                yield pa.RecordBatch.from_arrays([pa.array(names[:BATCH_NAMES]), pa.array(sizes[:BATCH_NAMES], pa.int64())], ["path", "length"])
                names, sizes = names[BATCH_NAMES:], sizes[BATCH_NAMES:]


def _listed_in_tasks(root: str) -> bool:
    """Whether the workers can list the folder; other stores are left to Spark's own scan."""
    try:
        store_of(root)
    except Exception:  # noqa: BLE001 - an unknown scheme, or a driver library that is not there
        return False
    return True


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``; contents are not read.

    In a store that only Spark reads, files of length zero are left out.
    """
    if not _listed_in_tasks(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    spark.dataSource.register(FolderListing)
    return spark.read.format(FolderListing.name()).option("root", root).load()


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of every image file below ``root``; Spark's scan leaves out the empty ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB)
    found = reader.load(root).select("path", "length", "content").filter("length > 0")
    empty = list_files(spark, root).filter((F.col("length") == 0) & has_image_suffix("path"))
    return found.unionByName(empty.withColumn("content", F.lit(b"")))


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's bytes to the file ``path`` below ``root``, in tasks; the number of files.

    A task that runs again writes the same bytes to the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top, _ = store_of(root)
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{top}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = files.select(path, F.col(content).cast("binary").alias(content)).mapInArrow(run, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def decodable(spark: SparkSession, root: str) -> DataFrame:
    """(path, decoded): whether each image file below ``root`` decodes; empty files are left out."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB)
    return reader.load(root).select(_plain_name("image.origin").alias("path"), (F.col("image.height") > 0).alias("decoded"))


def _plain_name(origin: str) -> Column:
    """The image source gives URL-encoded names; manifests hold plain ones."""
    return F.regexp_replace(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))), r"^(\w+):///", "$1:/")


def read_pixels(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Decoded images: ``path`` and the fields of Spark's image rows; undecodable files are left out.

    ``root`` is a folder or a short list of files.
    """
    if isinstance(root, list):
        root = [re.sub(r"([{}\[\]*?\\,])", r"\\\1", name) for name in root]
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "true")
        .load(root)
    )
    return images.select(_plain_name("image.origin").alias("path"), "image.*").drop("origin", "mode")


def class_dirs(listing: DataFrame, class_map: dict[str, int]) -> DataFrame:
    """(path, label) for image files whose parent folder is a known class."""
    classes = local_table(listing.sparkSession, list(class_map.items()), "class_name string, label int")
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return (
        listing.filter(has_image_suffix("path"))
        .withColumn("class_name", parent)
        .join(F.broadcast(classes), "class_name")
        .select("path", "label")
    )


def scan_class_dirs(spark: SparkSession, root: str, class_map: dict[str, int]) -> DataFrame:
    """Class folders directly below ``root``."""
    direct = rf"\Q{re.sub('^[a-z0-9]+:/*', '/', root.rstrip('/'))}\E/[^/]+/[^/]+$"
    return class_dirs(list_files(spark, root).filter(F.col("path").rlike(direct)), class_map)


def category_layout(listing: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Pool an inspection layout ``<category>/{train,test}/<kind>/<stem>.png`` into one manifest.

    Good samples of train and test are label 0; every other kind under test is label 1,
    with the path of its mask ``ground_truth/<kind>/<stem>_mask.png`` where one is listed.
    """
    part = lambda i: F.element_at(F.split("path", "/"), i)
    files = listing.filter(F.col("path").endswith(".png")).select(
        "path",
        part(-4).alias("category"),
        part(-3).alias("area"),
        part(-2).alias("defect_type"),
        F.regexp_replace(part(-1), r"\.png$", "").alias("stem"),
    )
    if categories is not None:
        files = files.filter(F.col("category").isin(categories))
    good = F.col("defect_type") == "good"
    samples = files.filter(((F.col("area") == "train") & good) | (F.col("area") == "test"))
    masks = files.filter((F.col("area") == "ground_truth") & F.col("stem").endswith("_mask")).select(
        "category",
        "defect_type",
        F.regexp_replace("stem", "_mask$", "").alias("stem"),
        F.col("path").alias("_mask"),
    )
    # A join key over (category, kind, stem) is spread by the stem.
    joined = samples.join(masks, ["category", "defect_type", "stem"], "left")
    return joined.select(
        "path",
        F.when(good, 0).otherwise(1).alias("label"),
        "defect_type",
        "category",
        F.when(~good, F.col("_mask")).alias("mask_path"),
    )


def scan_categories(spark: SparkSession, root: str, categories: list[str]) -> DataFrame:
    """One scan for all categories; no sample in any of them is an error."""
    manifest = category_layout(list_files(spark, root), categories)
    if manifest.isEmpty():
        raise ValueError(f"no samples of {categories} below {root}")
    return manifest


def enough_files(listing: DataFrame, minimum: int = EXPECTED_FILES) -> DataFrame:
    """One row: number of files and whether it reaches the minimum."""
    return listing.agg(F.count("*").alias("n_files")).withColumn("is_complete", F.col("n_files") >= minimum)


def check_file_count(spark: SparkSession, root: str, minimum: int = EXPECTED_FILES) -> bool:
    """Completeness gate of a folder; a missing folder is incomplete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    return enough_files(list_files(spark, root), minimum).first().is_complete
