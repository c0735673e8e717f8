"""Inventories, manifests and image rows.

The tables hold no image files: the queries write some, named by document attributes or with
bytes from embeddings, in tasks, and scan the folder.
"""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.catalog import PIXEL, PIXELS, SAMPLES, query, rounded, samples, sql_split, table
from tamis.functions.images import PNG_SIGNATURE
from tamis.operators.balance import apply_augmentation, augmentation_plan
from tamis.operators.cleaning import has_image_suffix, inspect_files, faulty_files, validation_summary
from tamis.operators.images import normalization_stats, pixel_stats
from tamis.operators.splits import stratified_split
from tamis.session import scratch_path, small_rows
from tamis.sources import files as store
from tamis.sources.manifests import read_manifest, write_manifest, write_norm_stats, write_samples

# Suffix a document's listed file gets from its source; others get .png.
SUFFIXES = {"src0": ".PNG", "src1": ".jpeg", "src2": ".txt", "src3": ".bmp", "src4": ".Jpg", "src5": ".gif"}
CLASS_MAP = {"en": 0, "de": 1, "fr": 2}

SQL_SUFFIX = "CASE source " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in SUFFIXES.items()) + " ELSE '.png' END"
SQL_LISTING = f"""listing AS (
  SELECT '/data/set/' || lang || '/' || CAST(doc_id AS VARCHAR) || {SQL_SUFFIX} AS path, lang, doc_id
  FROM documents)"""
SQL_IS_IMAGE = r"regexp_matches(lower(path), '\.(png|jpe?g|bmp)$')"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    suffix = F.lit(".png")
    for source, name in SUFFIXES.items():
        suffix = F.when(F.col("source") == source, F.lit(name)).otherwise(suffix)
    docs = table(spark, folder, "documents")
    return docs.select(F.concat(F.lit("/data/set/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))


def written(spark: SparkSession, files: DataFrame, root: str) -> str:
    """A fresh folder with an (empty) file for every path of ``files`` below ``root``."""
    place = scratch_path(spark, "files")
    relative = F.substring(F.col("path"), len(root) + 1, 1 << 20)
    store.write_files(files.select(relative.alias("path"), F.lit(b"").alias("content")), place)
    return place


def below(df: DataFrame, place: str, root: str, *columns: str) -> DataFrame:
    """Paths of a scanned folder with ``root`` in its place."""
    prefix = len(re.sub("^file:/*", "file:/", place if place.startswith("file:") else f"file:{place}")) + 1
    return df.withColumns({c: F.concat(F.lit(root), F.expr(f"substring({c}, {prefix + 1})")) for c in columns})


@query(
    "class_dir_manifest",
    f"""WITH {SQL_LISTING}
SELECT path, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS INTEGER) AS label
FROM listing WHERE lang IN ('en', 'de', 'fr') AND {SQL_IS_IMAGE}""",
)
def class_dir_manifest(spark, folder):
    place = written(spark, listing(spark, folder), "/data/set/")
    return below(store.scan_class_dirs(spark, place, CLASS_MAP), place, "/data/set/", "path")


@query(
    "image_suffix_filter",
    f"WITH {SQL_LISTING} SELECT path FROM listing WHERE {SQL_IS_IMAGE}",
)
def image_suffix_filter(spark, folder):
    return listing(spark, folder).filter(has_image_suffix("path"))


@query(
    "file_count_gate",
    f"WITH {SQL_LISTING} SELECT count(*) AS n_files, count(*) >= 6000 AS is_complete FROM listing",
)
def file_count_gate(spark, folder):
    return store.enough_files(store.list_files(spark, written(spark, listing(spark, folder), "/data/set/")))


def category_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an inspection layout: English is train/good, German test/good, the rest defects.

    Every French sample has a mask, of the Spanish ones those with an even text length.
    """
    docs = table(spark, folder, "documents")
    root = F.concat(F.lit("/data/parts/"), "source", F.lit("/"))
    stem = F.col("doc_id").cast("string")
    place = (
        F.when(F.col("lang") == "en", "train/good/")
        .when(F.col("lang") == "de", "test/good/")
        .when(F.col("lang") == "fr", "test/scratch/")
        .otherwise("test/dent/")
    )
    mask_dir = F.when(F.col("lang") == "fr", "ground_truth/scratch/").when(
        (F.col("lang") == "es") & (F.col("n_chars") % 2 == 0), "ground_truth/dent/"
    )
    files = F.array(
        F.concat(root, place, stem, F.lit(".png")), F.concat(root, mask_dir, stem, F.lit("_mask.png"))
    )
    return docs.select(F.explode(F.filter(files, lambda p: p.isNotNull())).alias("path"))


SQL_LAYOUT = """WITH placed AS (
  SELECT '/data/parts/' || source || '/' AS root, source AS category, CAST(doc_id AS VARCHAR) AS stem,
         CASE lang WHEN 'en' THEN 'train/good/' WHEN 'de' THEN 'test/good/'
                   WHEN 'fr' THEN 'test/scratch/' ELSE 'test/dent/' END AS place,
         CASE WHEN lang = 'fr' THEN 'ground_truth/scratch/'
              WHEN lang = 'es' AND n_chars % 2 = 0 THEN 'ground_truth/dent/' END AS mask_dir,
         CASE lang WHEN 'fr' THEN 'scratch' WHEN 'es' THEN 'dent' ELSE 'good' END AS defect_type
  FROM documents)
SELECT root || place || stem || '.png' AS path,
       CAST(CASE WHEN defect_type = 'good' THEN 0 ELSE 1 END AS INTEGER) AS label,
       defect_type, category, root || mask_dir || stem || '_mask.png' AS mask_path
FROM placed"""


@query("category_layout_manifest", SQL_LAYOUT)
def category_layout_manifest(spark, folder):
    place = written(spark, category_listing(spark, folder), "/data/parts/")
    return below(store.category_layout(store.list_files(spark, place)), place, "/data/parts/", "path", "mask_path")


@query("combined_categories_manifest", SQL_LAYOUT)
def combined_categories_manifest(spark, folder):
    found = small_rows(table(spark, folder, "documents").select("source").distinct(), "categories")
    place = written(spark, category_listing(spark, folder), "/data/parts/")
    return below(store.scan_categories(spark, place, [r.source for r in found]), place, "/data/parts/", "path", "mask_path")


@query(
    "manifest_csv_round_trip",
    f"""WITH {SAMPLES}, {sql_split('samples')}
SELECT CAST(doc_id AS VARCHAR) AS path, label, split FROM parted""",
)
def manifest_csv_round_trip(spark, folder):
    manifest = stratified_split(samples(spark, folder).select("doc_id", "label"), "doc_id", "label")
    path = scratch_path(spark, "manifest.csv")
    write_manifest(manifest.select(F.col("doc_id").cast("string").alias("path"), "label", "split"), path)
    return read_manifest(spark, path)


@query(
    "manifest_parquet_round_trip",
    "SELECT CAST(p_partkey AS VARCHAR) AS path, p_size AS label, 'train' AS split FROM part",
)
def manifest_parquet_round_trip(spark, folder):
    parts = table(spark, folder, "part")
    path = scratch_path(spark, "manifest") + ".parquet"
    named = parts.select(
        F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("int").alias("label"), F.lit("train").alias("split")
    )
    write_manifest(named, path)
    return read_manifest(spark, path)


# --- image bytes and pixels --------------------------------------------------------

# Header of an 8 x 8 bitmap file with 24 bits per pixel; fixed value.
BMP_HEADER = (
    "424D" "F6000000" "00000000" "36000000" "28000000" "08000000" "08000000"
    "0100" "1800" "00000000" "C0000000" "130B0000" "130B0000" "00000000" "00000000"
)


def pixel_hex(vec: str, repeat: int = 1) -> Column:
    def one(x: Column) -> Column:
        value = F.floor((x.cast("double") + F.lit(0.6)) * F.lit(200.0))
        return F.repeat(F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), value))), 2, "0"), repeat)

    return F.concat_ws("", F.transform(vec, one))


def embedding_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as an 8 x 8 grey image row."""
    rows = table(spark, folder, "embeddings")
    return rows.select(
        "vec_id",
        "label",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(pixel_hex("embedding")).alias("data"),
    )


def embedding_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a bitmap file; classes 3, 7 and 9 are cut short, mislabelled and empty."""
    rows = table(spark, folder, "embeddings")
    whole = F.unhex(F.concat(F.lit(BMP_HEADER), pixel_hex("embedding", 3)))
    broken = F.unhex(F.concat(F.lit("5858"), pixel_hex("embedding", 3)))
    content = (
        F.when(F.col("label") == 3, F.substring(whole, 1, 200))
        .when(F.col("label") == 7, broken)
        .when(F.col("label") == 9, F.unhex(F.lit("")))
        .otherwise(whole)
    )
    return rows.select("vec_id", "label", content.alias("content"))


@query(
    "file_faults",
    """SELECT vec_id, CASE label WHEN 3 THEN 'truncated' WHEN 7 THEN 'unrecognised' ELSE 'empty' END AS reason
FROM embeddings WHERE label IN (3, 7, 9)""",
)
def file_faults(spark, folder):
    return faulty_files(inspect_files(embedding_files(spark, folder), "vec_id"), "vec_id")


FORMATS = ("png", "jpg", "bmp")


def jpeg_samples(spark: SparkSession) -> list[bytes]:
    """A small JPEG file for each of ten grey values, by the encoder that comes with Java."""
    java = spark._jvm.java
    out = []
    for i in range(10):
        image = java.awt.image.BufferedImage(8, 8, java.awt.image.BufferedImage.TYPE_INT_RGB)
        for at in range(64):
            image.setRGB(at % 8, at // 8, 0x010101 * ((25 * i + at) % 256))
        stream = java.io.ByteArrayOutputStream()
        spark._jvm.javax.imageio.ImageIO.write(image, "jpg", stream)
        out.append(bytes(stream.toByteArray()))
    return out


def png_file(pixels: Column) -> Column:
    """A PNG file of 8 x 8 grey pixels (64 bytes)."""

    def one(data: bytes) -> bytes:
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        lines = b"".join(b"\0" + data[i : i + 8] for i in range(0, 64, 8))
        return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    return F.pandas_udf(lambda column: column.map(one), "binary")(pixels)


def format_files(spark: SparkSession, folder: str) -> DataFrame:
    """An image file per embedding, its format by ``vec_id``: whole, cut, broken, empty or with bytes after its end."""
    rows = table(spark, folder, "embeddings")
    jpegs = F.array(*[F.lit(j) for j in jpeg_samples(spark)])
    whole = (
        F.when(F.col("vec_id") % 3 == 0, png_file(F.unhex(pixel_hex("embedding"))))
        .when(F.col("vec_id") % 3 == 1, F.element_at(jpegs, (F.col("label") % 10 + 1).cast("int")))
        .otherwise(F.unhex(F.concat(F.lit(BMP_HEADER), pixel_hex("embedding", 3))))
    )
    names = F.array(*[F.lit(f) for f in FORMATS])
    name = F.concat(F.col("vec_id").cast("string"), F.lit("."), F.element_at(names, (F.col("vec_id") % 3 + 1).cast("int")))
    state = F.floor(F.col("vec_id") / 3) % 5
    content = (
        F.when(state == 1, F.expr("substring(whole, 1, length(whole) * 2 div 3)"))
        .when(state == 2, F.concat(F.lit(b"XXXX"), F.expr("substring(whole, 5)")))
        .when(state == 3, F.lit(b""))
        .when(state == 4, F.concat("whole", F.lit(b"more bytes")))
        .otherwise(F.col("whole"))
    )
    return rows.select("vec_id", name.alias("path"), whole.alias("whole")).select("path", content.alias("content"))


@query(
    "decoded_file_faults",
    """SELECT CAST(vec_id AS VARCHAR) || CASE vec_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.bmp' END AS path,
       CASE (vec_id // 3) % 5 WHEN 1 THEN 'truncated' WHEN 2 THEN 'unrecognised' ELSE 'empty' END AS reason
FROM embeddings WHERE (vec_id // 3) % 5 IN (1, 2, 3)""",
)
def decoded_file_faults(spark, folder):
    """Files of three formats, written in tasks, decoded by Spark's image source and checked for structure."""
    place = scratch_path(spark, "images")
    store.write_files(format_files(spark, folder), place)
    inspected = inspect_files(store.read_files(spark, place), decoded=store.decodable(spark, place))
    return below(faulty_files(inspected), place, "", "path")


@query(
    "validation_summary",
    f"""WITH {PIXELS}, bytes AS (
  SELECT vec_id, label, string_agg(printf('%02X', px), '' ORDER BY pos) AS body
  FROM (SELECT vec_id, label, {PIXEL} AS px, pos FROM (
    SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS pos FROM embeddings))
  GROUP BY vec_id, label),
files AS (
  SELECT vec_id, CASE label WHEN 3 THEN 'cut' || substr(body, 1, 97) WHEN 7 THEN 'bad' || body
                            WHEN 9 THEN '' ELSE body END AS content,
         label IN (3, 7) AS corrupt, label = 9 AS unreadable FROM bytes),
grouped AS (SELECT content, count(*) AS n FROM files GROUP BY content)
SELECT (SELECT count(*) FROM files) AS total_files,
       (SELECT count(*) FROM files WHERE corrupt) AS n_corrupt,
       (SELECT count(*) FROM files WHERE unreadable) AS n_unreadable,
       (SELECT count(*) FROM grouped WHERE n > 1) AS n_duplicate_groups,
       NOT EXISTS (SELECT 1 FROM files WHERE corrupt OR unreadable) AS is_clean""",
)
def validate(spark, folder):
    return validation_summary(inspect_files(embedding_files(spark, folder), "vec_id"))


SQL_NORM = f"""WITH {PIXELS}, stats AS (
  SELECT avg(px / 255.0::DOUBLE) AS m, avg((px / 255.0::DOUBLE) * (px / 255.0::DOUBLE)) AS q FROM pixels)
SELECT CAST(channel AS INTEGER) AS channel, round(m, 6) AS mean, round(sqrt(q - m * m), 6) AS std
FROM stats, (SELECT unnest([0, 1, 2]) AS channel)"""


@query("image_norm_stats", SQL_NORM)
def image_norm_stats(spark, folder):
    return rounded(normalization_stats(embedding_images(spark, folder), "vec_id", sample=None), "mean", "std")


@query("norm_stats_json_round_trip", SQL_NORM)
def norm_stats_json_round_trip(spark, folder):
    path = scratch_path(spark, "norm-stats")
    write_norm_stats(normalization_stats(embedding_images(spark, folder), "vec_id", sample=None), path)
    stored = spark.read.schema("mean array<double>, std array<double>").json(path)
    rows = stored.select(F.posexplode(F.arrays_zip("mean", "std")).alias("channel", "c"))
    return rounded(rows.select("channel", "c.mean", "c.std"), "mean", "std")


@query(
    "image_pixel_stats",
    f"""WITH {PIXELS}
SELECT vec_id, round(avg(px), 6) AS mean, round(stddev_pop(px), 6) AS std, min(px) AS min, max(px) AS max
FROM pixels GROUP BY vec_id""",
)
def image_pixel_stats(spark, folder):
    return rounded(pixel_stats(embedding_images(spark, folder), "vec_id"), "mean", "std")


def class_target(df: DataFrame) -> int:
    """Twice the size of class 0: how far the rare class is raised in the examples."""
    return 2 * df.filter("label = 0").count()


@query("augmented_image_round_trip")
def augmented_image_round_trip(spark, folder):
    images = embedding_images(spark, folder)
    plan = augmentation_plan(images, "vec_id", "label", 0, class_target(images))
    path = scratch_path(spark, "augmented")
    write_samples(apply_augmentation(images, plan, "vec_id"), path)
    return spark.read.parquet(path)
