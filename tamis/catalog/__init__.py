"""Registered queries with their SQL equivalents.

Every query takes (spark, folder of the parquet tables) and reads whole tables. Where
SQL can express the same result on the same tables, its text is kept beside the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL equivalent where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: (doc_id, text, lang, source, n_chars, label, toxic)."""
    labels = table(spark, folder, "labels").withColumnRenamed("quality", "label")
    return table(spark, folder, "documents").join(labels, "doc_id")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- SQL fragments -----------------------------------------------------------------

SAMPLES = """samples AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality AS label, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def sql_code(use: str, *keys: str) -> str:
    """The hash of ``key_code`` in SQL."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '42', '{use}', {parts}))"


def sql_uniform(use: str, *keys: str) -> str:
    """The draw of ``key_uniform`` in SQL."""
    return f"(CAST(CAST('0x' || substr({sql_code(use, *keys)}, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_units(score: str) -> str:
    return f"CAST(floor(({score}) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def sql_split(source: str, key: str = "doc_id", label: str = "label", within: str | None = None) -> str:
    """CTEs ending in ``parted``: ``source`` with its stratified 70/15/15 split."""
    by = f"{within}, " if within else ""
    over = f"PARTITION BY {within}" if within else ""
    return f"""sizes AS (
  SELECT {by}{label}, count(*) AS n FROM {source} GROUP BY {by}{label}),
first_cut AS (
  SELECT *, sum(n) OVER ({over}) AS total,
         CAST(floor(0.7::DOUBLE * sum(n) OVER ({over})) AS HUGEINT) AS m FROM sizes),
first_base AS (
  SELECT *, (m * n) // total AS base, (m * n) % total AS part FROM first_cut),
first_alloc AS (
  SELECT *, base + CASE WHEN row_number() OVER ({over} ORDER BY part DESC, {label})
                        <= m - sum(base) OVER ({over}) THEN 1 ELSE 0 END AS a FROM first_base),
second_cut AS (
  SELECT *, n - a AS rest, total - m AS rest_total,
         CAST(floor(0.5::DOUBLE * (total - m)) AS HUGEINT) AS m2 FROM first_alloc),
second_base AS (
  SELECT *, (m2 * rest) // greatest(rest_total, 1) AS base2, (m2 * rest) % greatest(rest_total, 1) AS part2
  FROM second_cut),
alloc AS (
  SELECT *, base2 + CASE WHEN row_number() OVER ({over} ORDER BY part2 DESC, {label})
                         <= m2 - sum(base2) OVER ({over}) THEN 1 ELSE 0 END AS b FROM second_base),
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY {by}{label} ORDER BY {sql_code('split', key)}) AS place
  FROM {source} s),
parted AS (
  SELECT p.* EXCLUDE (place),
         CASE WHEN p.place <= c.a THEN 'train' WHEN p.place <= c.a + c.b THEN 'val' ELSE 'test' END AS split
  FROM placed p JOIN alloc c USING ({by}{label}))"""


# The pixel value that stands for one embedding component.
PIXEL = "CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 0.6::DOUBLE) * 200))) AS INTEGER)"
PIXELS = f"""pixels AS (
  SELECT vec_id, label, {PIXEL} AS px
  FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings))"""


def load() -> None:
    """Import every module that registers queries."""
    from tamis.catalog import acquisition, audits, balance, cleaning, comparison, files, noise, splits  # noqa: F401
