"""Filters, duplicates, removal, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import SAMPLES, query, samples, sql_split, table
from tamis.catalog.files import embedding_files
from tamis.operators import cleaning as ops
from tamis.operators.splits import stratified_split
from tamis.session import materialise, scratch_path

SQL_COPIES = """hashed AS (SELECT doc_id, md5(text) AS content_md5 FROM documents),
grouped AS (
  SELECT content_md5, count(*) AS group_size, min(doc_id) AS first_key FROM hashed
  GROUP BY content_md5 HAVING count(*) > 1)"""

SQL_DEDUPED = f"""{SAMPLES}, deduped AS (
  SELECT * FROM samples WHERE doc_id IN (SELECT min(doc_id) FROM samples GROUP BY md5(text)))"""


@query(
    "select_split",
    f"WITH {SAMPLES}, {sql_split('samples')} SELECT doc_id, label FROM parted WHERE split = 'val'",
)
def select_split(spark, folder):
    parted = stratified_split(samples(spark, folder).select("doc_id", "label"), "doc_id", "label")
    return ops.select_split(parted, "val").select("doc_id", "label")


@query(
    "label_by_position",
    """SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS INTEGER) AS label
FROM documents""",
)
def label_by_position(spark, folder):
    return ops.label_by_position(table(spark, folder, "documents"), "lang", ["en", "de", "fr"]).select("doc_id", "label")


@query("default_columns", "SELECT doc_id, 'train' AS split, FALSE AS is_outlier FROM documents")
def default_columns(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.withColumns({"split": F.lit("train"), "is_outlier": F.lit(False)})


@query("label_cast", "SELECT p_partkey, CAST(p_size AS INTEGER) AS label FROM part")
def label_cast(spark, folder):
    text = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("string").alias("label"))
    return text.withColumn("label", F.col("label").cast("int"))


@query("defective_only", f"WITH {SAMPLES} SELECT doc_id, lang, label FROM samples WHERE label = 1")
def defective_only(spark, folder):
    return samples(spark, folder).filter("label = 1").select("doc_id", "lang", "label")


@query("duplicate_groups", f"WITH {SQL_COPIES} SELECT * FROM grouped")
def duplicate_groups(spark, folder):
    docs = table(spark, folder, "documents")
    return ops.duplicate_groups(ops.content_hashes(docs, "doc_id", "text"), "doc_id")


@query(
    "duplicate_members",
    f"""WITH {SQL_COPIES}
SELECT content_md5, group_size, doc_id, doc_id = first_key AS is_first FROM hashed JOIN grouped USING (content_md5)""",
)
def duplicate_members(spark, folder):
    docs = table(spark, folder, "documents")
    return ops.duplicate_members(ops.content_hashes(docs, "doc_id", "text"), "doc_id")


@query(
    "drop_listed",
    f"""WITH {SAMPLES} SELECT doc_id, lang, label FROM samples
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def drop_listed(spark, folder):
    bad = table(spark, folder, "labels").filter("toxic = 1")
    return ops.drop_listed(samples(spark, folder), bad, "doc_id").select("doc_id", "lang", "label")


@query(
    "resolve_duplicates",
    """SELECT doc_id, lang, source, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))""",
)
def resolve_duplicates(spark, folder):
    docs = table(spark, folder, "documents")
    return ops.resolve_duplicates(docs, "doc_id", "text").select("doc_id", "lang", "source", "n_chars")


@query(
    "clean_and_split_counts",
    f"""WITH {SQL_DEDUPED}, {sql_split('deduped')}
SELECT split, label, count(*) AS n FROM parted GROUP BY split, label""",
)
def clean_and_split_counts(spark, folder):
    """Labelled documents, exact copies removed, split 70/15/15: rows per split and class.

    Texts are hashed before the join, so they are never shuffled; the narrow rows that
    the split reads several times are written once.
    """
    hashes = ops.content_hashes(table(spark, folder, "documents"), "doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = materialise(hashes.join(labels, "doc_id"))
    clean = ops.keep_first(rows.select("doc_id", "label"), rows.select("doc_id", "content_md5"), "doc_id", stored=True)
    return stratified_split(clean, "doc_id", "label").groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "clean_manifest",
    f"""WITH kept AS (SELECT vec_id, label FROM embeddings e WHERE label NOT IN (3, 7, 9) AND vec_id IN (
  SELECT min(vec_id) FROM embeddings WHERE label NOT IN (3, 7, 9) GROUP BY embedding)),
{sql_split('kept', 'vec_id')}
SELECT vec_id, label, split FROM parted""",
)
def clean_manifest(spark, folder):
    """Faulty files and copies removed in one inspection pass, then split."""
    files = embedding_files(spark, folder)
    clean = ops.clean_manifest(files, table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id")
    return stratified_split(clean, "vec_id", "label")


@query(
    "align_by_key",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def align_by_key(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return ops.align(docs, table(spark, folder, "labels"), "doc_id")


@query(
    "update_listed_labels",
    f"""WITH {SAMPLES}
SELECT doc_id, CASE WHEN toxic = 1 THEN 1 - label ELSE label END AS label FROM samples""",
)
def update_listed_labels(spark, folder):
    changes = table(spark, folder, "labels").filter("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("new"))
    rows = samples(spark, folder).select("doc_id", "label")
    return ops.update_listed(rows, changes, "doc_id", "label", "new")


@query(
    "cleaning_funnel",
    """WITH steps AS (
  SELECT count(*) AS c0, count(*) FILTER (n_chars >= 20) AS c1,
         count(*) FILTER (n_chars >= 20 AND lang = 'en') AS c2,
         count(*) FILTER (n_chars >= 20 AND lang = 'en' AND length(text) > 100) AS c3 FROM documents)
SELECT 1 AS step_no, 'long enough' AS step, c0 AS rows_before, c1 AS rows_after FROM steps
UNION ALL SELECT 2, 'english', c1, c2 FROM steps
UNION ALL SELECT 3, 'more than a line', c2, c3 FROM steps""",
)
def cleaning_funnel(spark, folder):
    return ops.funnel(
        table(spark, folder, "documents"),
        {
            "long enough": F.col("n_chars") >= 20,
            "english": F.col("lang") == "en",
            "more than a line": F.length("text") > 100,
        },
    )


@query(
    "cleaning_funnel_observed",
    f"""WITH sound AS (SELECT * FROM embeddings WHERE label NOT IN (3, 7, 9)),
kept AS (SELECT vec_id, label FROM sound WHERE vec_id IN (SELECT min(vec_id) FROM sound GROUP BY embedding)),
{sql_split('kept', 'vec_id')}, steps AS (
  SELECT (SELECT count(*) FROM embeddings) AS c0, (SELECT count(*) FROM sound) AS c1, (SELECT count(*) FROM kept) AS c2,
         (SELECT count(*) FROM parted WHERE split = 'train') AS c3)
SELECT 1 AS step_no, 'without faults' AS step, c0 AS rows_before, c1 AS rows_after FROM steps
UNION ALL SELECT 2, 'without copies', c1, c2 FROM steps
UNION ALL SELECT 3, 'train rows', c2, c3 FROM steps""",
)
def cleaning_funnel_observed(spark, folder):
    """Counts of the cleaning and the split, taken while they run."""
    watch = ops.Funnel()
    files, manifest = embedding_files(spark, folder), table(spark, folder, "embeddings").select("vec_id", "label")
    clean = materialise(ops.clean_manifest(files, manifest, "vec_id", watch=watch))
    train = watch.step("train rows", stratified_split(clean, "vec_id", "label").filter("split = 'train'"))
    train.write.parquet(scratch_path(spark, "train-manifest"))
    return watch.counts(spark)
