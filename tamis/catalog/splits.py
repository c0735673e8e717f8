"""Splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import SAMPLES, query, samples, sql_code, sql_split, sql_uniform, table
from tamis.operators import splits as ops


def labelled(spark, folder):
    return samples(spark, folder).select("doc_id", "lang", "label")


@query(
    "stratified_split",
    f"WITH {SAMPLES}, {sql_split('samples')} SELECT doc_id, label, split FROM parted",
)
def stratified_split(spark, folder):
    return ops.stratified_split(labelled(spark, folder).drop("lang"), "doc_id", "label")


@query(
    "stratified_split_large",
    f"""WITH {sql_split('events', 'event_id', 'event_type')}
SELECT event_type, split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM parted GROUP BY event_type, split""",
)
def stratified_split_large(spark, folder):
    """A few classes of very many rows."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    parted = ops.stratified_split(events, "event_id", "event_type").groupBy("event_type", "split")
    return parted.agg(F.count("*").alias("n"), F.sum("event_id").alias("checksum"))


@query(
    "stratified_split_by_category",
    f"WITH {SAMPLES}, {sql_split('samples', within='lang')} SELECT doc_id, lang, label, split FROM parted",
)
def stratified_split_by_category(spark, folder):
    return ops.stratified_split(labelled(spark, folder), "doc_id", "label", within=["lang"])


@query(
    "stratified_kfold",
    f"""WITH {SAMPLES}
SELECT doc_id, label,
       CAST(ntile(5) OVER (PARTITION BY label ORDER BY {sql_code('fold', 'doc_id')}) - 1 AS INTEGER) AS fold
FROM samples""",
)
def stratified_kfold(spark, folder):
    return ops.stratified_kfold(labelled(spark, folder).drop("lang"), "doc_id", "label")


@query(
    "sample_n",
    f"SELECT doc_id, lang FROM documents ORDER BY {sql_code('sample', 'doc_id')} LIMIT 500",
)
def sample_n(spark, folder):
    return ops.sample_n(table(spark, folder, "documents"), "doc_id", 500).select("doc_id", "lang")


@query(
    "sample_per_class",
    f"""SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {sql_code('grid', 'doc_id')}) <= 4""",
)
def sample_per_class(spark, folder):
    return ops.sample_per_class(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "lang", 4)


@query(
    "sample_with_replacement",
    f"""WITH ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_code('draw', 'doc_id')}) AS place, count(*) OVER () AS n FROM documents),
draws AS (
  SELECT draw, 1 + CAST(floor({sql_uniform('draw', 'draw')} * (SELECT CAST(count(*) AS DOUBLE) FROM documents)) AS BIGINT) AS place
  FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS draw))
SELECT draw, doc_id FROM draws JOIN ranked USING (place)""",
)
def sample_with_replacement(spark, folder):
    docs = table(spark, folder, "documents")
    return ops.sample_with_replacement(docs, "doc_id", docs.count())


@query(
    "split_crosstab",
    f"""WITH {SAMPLES}, {sql_split('samples', within='lang')}
SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
       count(*) FILTER (split = 'test') AS test
FROM parted GROUP BY lang""",
)
def split_crosstab(spark, folder):
    return ops.split_crosstab(stratified_split_by_category(spark, folder), "lang")


@query(
    "seed_pool_split",
    f"""WITH {SAMPLES}, sizes AS (SELECT label, count(*) AS n FROM samples GROUP BY label),
cut AS (
  SELECT *, sum(n) OVER () AS total, CAST(floor(0.1::DOUBLE * sum(n) OVER ()) AS HUGEINT) AS m FROM sizes),
base AS (SELECT *, (m * n) // total AS base, (m * n) % total AS part FROM cut),
alloc AS (
  SELECT label, base + CASE WHEN row_number() OVER (ORDER BY part DESC, label) <= m - sum(base) OVER ()
                            THEN 1 ELSE 0 END AS a FROM base),
placed AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_code('seed', 'doc_id')}) AS place FROM samples)
SELECT doc_id, label, place <= a AS is_seed FROM placed JOIN alloc USING (label)""",
)
def seed_pool_split(spark, folder):
    return ops.seed_pool_split(labelled(spark, folder).drop("lang"), "doc_id", "label")
