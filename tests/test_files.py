"""Folder scans, file faults and image statistics on real files."""

import pytest
from pyspark.sql import functions as F

from tamis.functions.images import fault_of
from tamis.operators.balance import apply_augmentation, augmentation_plan
from tamis.operators.cleaning import inspect_files
from tamis.operators.images import normalization_stats, pixel_stats
from tamis.plans import curation
from tamis.sources.files import check_file_count, decodable, list_files, read_files, read_pixels, scan_categories, scan_class_dirs, store_of, write_files
from tests.images import png, put


def name(column="path"):
    return F.regexp_extract(column, r"([^/]+)$", 1)


@pytest.fixture()
def class_folder(tmp_path):
    for i in range(20):
        put(tmp_path / "raw" / "ok" / f"ok_{i}.png", png(8, 8, (i, 2 * i, 3 * i)))
        put(tmp_path / "raw" / "bad" / f"bad_{i}.png", png(8, 8, (100 + i, i, 7)))
    put(tmp_path / "raw" / "ok" / "upper.PNG", png(8, 8, (200, 1, 1)))
    put(tmp_path / "raw" / "ok" / "copy_of_0.png", png(8, 8, (0, 0, 0)))
    put(tmp_path / "raw" / "ok" / "notes.txt", b"not an image")
    put(tmp_path / "raw" / "ok" / "cut.png", png(8, 8, (1, 1, 1))[:-20])
    put(tmp_path / "raw" / "ok" / "junk.png", b"\x89PNG\r\n\x1a\n" + b"junk" * 10)
    put(tmp_path / "raw" / "bad" / "empty.jpg", b"")
    put(tmp_path / "raw" / "other" / "x.png", png(8, 8, (9, 9, 9)))
    return str(tmp_path / "raw")


def test_class_dirs(spark, class_folder):
    rows = scan_class_dirs(spark, class_folder, {"ok": 0, "bad": 1, "missing": 2}).select(name().alias("n"), "label").collect()
    labels = {r.n: r.label for r in rows}
    assert labels["upper.PNG"] == 0 and labels["bad_3.png"] == 1
    assert "notes.txt" not in labels and "x.png" not in labels
    assert len(labels) == 45


def test_empty_scan_keeps_its_schema(spark, class_folder):
    assert scan_class_dirs(spark, class_folder, {"missing": 0}).columns == ["path", "label"]


def test_validate_folder(spark, class_folder):
    report = curation.validate_folder(spark, class_folder)
    faults = {r.n: r.reason for r in report["faulty"].select(name().alias("n"), "reason").collect()}
    assert faults == {"cut.png": "truncated", "junk.png": "truncated", "empty.jpg": "empty"}
    groups = report["duplicates"].select(name().alias("n"), "is_first").collect()
    assert {(r.n, r.is_first) for r in groups} == {("copy_of_0.png", True), ("ok_0.png", False)}
    summary = report["summary"].first()
    assert (summary.total_files, summary.n_corrupt, summary.n_unreadable, summary.n_duplicate_groups) == (46, 2, 1, 1)
    assert summary.is_clean is False


def test_fault_of_formats():
    whole = png(4, 4, (1, 2, 3))
    assert fault_of(whole) is None
    assert fault_of(whole[:40] + b"?" + whole[41:]) == "bad checksum"
    assert fault_of(b"\xff\xd8 ... \xff\xd9") is None
    assert fault_of(b"\xff\xd8 ...") == "truncated"
    assert fault_of(b"BM" + (60).to_bytes(4, "little") + bytes(54)) is None
    assert fault_of(b"BM" + (99).to_bytes(4, "little") + bytes(54)) == "truncated"
    assert fault_of(b"hello") == "unrecognised"


def encoded(spark, path, kind):
    """A small image written by the JVM in the given format; its bytes."""
    image = spark._jvm.java.awt.image.BufferedImage(16, 16, 1)
    for i in range(16):
        image.setRGB(i, i, 0x336699 + 7 * i)
    path.parent.mkdir(parents=True, exist_ok=True)
    assert spark._jvm.javax.imageio.ImageIO.write(image, kind, spark._jvm.java.io.File(str(path)))
    return path.read_bytes()


def test_sound_and_broken_files_of_every_format(spark, tmp_path):
    root = tmp_path / "formats"
    whole = {kind: encoded(spark, root / f"whole.{kind}", kind) for kind in ("png", "jpg", "bmp")}
    sound = set(f"whole.{kind}" for kind in whole)
    for kind, data in whole.items():
        put(root / f"trailing.{kind}", data + b"some more")
        put(root / f"cut.{kind}", data[: len(data) * 2 // 3])
        put(root / f"empty.{kind}", b"")
        put(root / f"text.{kind}", b"not an image at all")
        sound.add(f"trailing.{kind}")
    # Another format under an image's name, and a size field that nobody reads.
    other = encoded(spark, tmp_path / "other" / "x.gif", "gif")
    put(root / "other.png", other)
    put(root / "size.bmp", whole["bmp"][:2] + bytes([1, 2, 3, 4]) + whole["bmp"][6:])
    # A preview in a header segment ends with the end marker as well.
    preview = b"\xff\xe1" + (2 + len(whole["jpg"])).to_bytes(2, "big") + whole["jpg"]
    assert fault_of(whole["jpg"][:2] + preview + whole["jpg"][2:]) is None
    assert fault_of(whole["jpg"][:2] + preview + whole["jpg"][2:-40]) == "truncated"
    put(root / "body.jpg", b"\xff\xd8 ... \xff\xd9")
    sound |= {"other.png", "size.bmp"}
    inspected = inspect_files(read_files(spark, str(root)), decoded=decodable(spark, str(root)))
    faults = {r.n: r.fault for r in inspected.select(name().alias("n"), "fault").collect()}
    assert len(faults) == 18
    assert {n for n, fault in faults.items() if fault is None} == sound
    assert {n for n, fault in faults.items() if fault == "empty"} == {f"empty.{k}" for k in whole}
    assert faults["body.jpg"] == "undecodable"
    files = read_files(spark, str(root)).select("path").withColumn("split", F.lit("train"))
    kept = curation.clean_within_split(read_files(spark, str(root)), files, decoded=decodable(spark, str(root)))
    assert {r.n for r in kept.select(name().alias("n")).collect()} == sound


def test_cleaned_manifest(spark, class_folder, tmp_path):
    rows = curation.cleaned_manifest(spark, class_folder, ["ok", "bad"], str(tmp_path / "clean.csv"))
    found = rows.select(name().alias("n"), "label", "split").collect()
    assert len(found) == 41
    assert not {"cut.png", "junk.png", "empty.jpg", "ok_0.png"} & {r.n for r in found}
    assert {r.split for r in found} == {"train", "val", "test"}
    baseline = curation.baseline_manifest(spark, class_folder, ["ok", "bad"], str(tmp_path / "base.parquet"))
    assert baseline.count() == 45


def test_category_layout(spark, tmp_path):
    root = tmp_path / "parts"
    for category in ("bolt", "nut"):
        for i in range(10):
            put(root / category / "train" / "good" / f"{i:03}.png", b"x")
        for i in range(4):
            put(root / category / "test" / "good" / f"{i:03}.png", b"x")
            put(root / category / "test" / "scratch" / f"{i:03}.png", b"x")
        put(root / category / "test" / "dent" / "000.png", b"x")
        put(root / category / "test" / "dent" / "001.PNG", b"x")
        for i in range(3):
            put(root / category / "ground_truth" / "scratch" / f"{i:03}_mask.png", b"x")
    rows = scan_categories(spark, str(root), ["bolt"])
    assert rows.count() == 19
    assert rows.filter("label = 0").count() == 14
    assert rows.filter("mask_path IS NOT NULL").count() == 3
    assert rows.filter("defect_type = 'dent' AND mask_path IS NULL").count() == 1
    with pytest.raises(ValueError):
        scan_categories(spark, str(root), ["three"])
    stored, table = curation.category_manifest(spark, str(root), ["bolt", "nut"], str(tmp_path / "m.csv"))
    assert stored.count() == 38
    assert [(r.category, r.train, r.val, r.test) for r in table.orderBy("category").collect()] == [
        ("bolt", 13, 3, 3),
        ("nut", 13, 3, 3),
    ]


def test_file_count_gate(spark, class_folder, tmp_path):
    assert check_file_count(spark, class_folder, 47)
    assert not check_file_count(spark, class_folder, 48)
    assert not check_file_count(spark, str(tmp_path / "absent"), 1)


def test_channel_order_and_stats(spark, tmp_path):
    put(tmp_path / "img" / "a.png", png(4, 4, (10, 20, 30)))
    put(tmp_path / "img" / "b.png", png(2, 4, (40, 50, 60)))
    images = read_pixels(spark, str(tmp_path / "img"))
    stats = {r.channel: (r["mean"], r["std"]) for r in normalization_stats(images, "path").collect()}
    # 16 pixels of one colour and 8 of the other.
    assert stats[0][0] == pytest.approx((16 * 10 + 8 * 40) / 24 / 255)
    assert stats[2][0] == pytest.approx((16 * 30 + 8 * 60) / 24 / 255)
    spread = (16 * 100 + 8 * 400) / 24
    assert stats[1][1] == pytest.approx(spread**0.5 / 255)
    each = {r.n: r for r in pixel_stats(images, "path").withColumn("n", name()).collect()}
    assert each["a.png"]["mean"] == pytest.approx(20) and each["a.png"]["max"] == 30


def test_preprocessing_stats_use_train_rows_only(spark, tmp_path):
    put(tmp_path / "img" / "a {1}+.png", png(4, 4, (0, 0, 0)))
    put(tmp_path / "img" / "b.png", png(4, 4, (255, 255, 255)))
    files = read_files(spark, str(tmp_path / "img"))
    assert read_pixels(spark, str(tmp_path / "img")).join(files, "path").count() == 2
    split = F.when(name() == "a {1}+.png", "train").otherwise("test")
    manifest = files.select("path", split.alias("split"))
    curation.preprocessing_stats(spark, manifest, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["mean"] == [0.0, 0.0, 0.0]


def test_augmentation(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "img" / f"{i}.png", png(6, 5, (10 * i, 50, 200)))
    images = read_pixels(spark, str(tmp_path / "img")).withColumn("label", F.lit(1))
    plan = augmentation_plan(images, "path", "label", 1, 40)
    assert plan.count() == 37
    assert plan.filter("split <> 'train' OR label <> 1").count() == 0
    rendered = apply_augmentation(images, plan, "path", (16, 12))
    rows = rendered.collect()
    assert len(rows) == 37 and all(len(r.data) == 16 * 12 * 3 for r in rows)
    again = {r.aug_key: bytes(r.data) for r in apply_augmentation(images.repartition(5), plan, "path", (16, 12)).collect()}
    assert again == {r.aug_key: bytes(r.data) for r in rows}
    # A copy without light or noise keeps its colours; pixels are stored in BGR order.
    plain = plan.filter("contrast = 0 AND brightness = 0 AND noise_var = 0").first()
    pixels = next(bytes(r.data) for r in rows if r.aug_key == plain.aug_key)
    assert set(pixels[0::3]) == {200} and set(pixels[1::3]) == {50}
    assert augmentation_plan(images, "path", "label", 1, 3).count() == 0


def test_listing_in_tasks(spark, tmp_path):
    root = tmp_path / "with space+%41"
    for name_, data in (("a/x.png", b"12"), ("a/deep/er/y.PNG", b""), ("b/z é.txt", b"1"), ("top.png", b"123"), ("_hidden/q.png", b"1"), ("a/.h.png", b"1")):
        put(root / name_, data)
    listed = list_files(spark, str(root))
    # the root itself and two visible folders
    assert listed.rdd.getNumPartitions() == 3
    found = {r.path: r.length for r in listed.collect()}
    assert found == {f"file:{root}/{n}": size for n, size in (("a/x.png", 2), ("a/deep/er/y.PNG", 0), ("b/z é.txt", 1), ("top.png", 3))}
    # the names are those of Spark's own scans
    scanned = {r.path for r in read_files(spark, f"file://{root}").collect()}
    assert scanned == {p for p in found if p.lower().endswith(".png")}
    assert {r.path for r in list_files(spark, f"file://{root}/").collect()} == set(found)
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert list_files(spark, str(empty)).count() == 0
    with pytest.raises(Exception):
        list_files(spark, str(tmp_path / "absent")).count()


def test_stores_are_told_by_their_scheme():
    assert store_of("/a/b/")[1:] == ("/a/b", "file:") and store_of("file:///a")[1:] == ("/a", "file:") and store_of("file:/a")[1:] == ("/a", "file:")
    with pytest.raises(Exception):
        store_of("viewfs://store/a")


def test_written_files_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.png", bytearray(b"x")), ("a/2.png", bytearray()), ("b/c/3.png", None)], "path string, content binary")
    assert write_files(rows.repartition(2), str(tmp_path / "out")) == 3 and write_files(rows, str(tmp_path / "out")) == 3
    assert {(r.path.split("/out/")[1], bytes(r.content)) for r in read_files(spark, str(tmp_path / "out")).collect()} == {("a/1.png", b"x"), ("a/2.png", b""), ("b/c/3.png", b"")}
    assert write_files(rows.limit(0), str(tmp_path / "none")) == 0
