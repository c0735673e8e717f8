"""Class balance, breakdowns, agreement and vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import SAMPLES, query, rounded, samples, table
from tamis.operators import audit as ops
from tamis.session import scratch_path

SQL_RATIO = "round(max(n) / CAST(min(n) AS DOUBLE), 6)"


@query("class_distribution", f"WITH {SAMPLES} SELECT label, count(*) AS n FROM samples GROUP BY label")
def class_distribution(spark, folder):
    return ops.class_distribution(samples(spark, folder), "label")


@query("class_distribution_large", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def class_distribution_large(spark, folder):
    return ops.class_distribution(table(spark, folder, "lineitem"), "l_returnflag")


@query(
    "imbalance",
    f"""WITH {SAMPLES}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_class,
       (SELECT label FROM c ORDER BY n, label LIMIT 1) AS minority_class, {SQL_RATIO} AS ratio FROM c""",
)
def imbalance(spark, folder):
    return rounded(ops.imbalance(samples(spark, folder), "label"), "ratio")


@query(
    "label_audit",
    f"""WITH {SAMPLES}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n_samples, {SQL_RATIO} AS imbalance_ratio,
       string_agg(CAST(label AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY label) AS class_counts FROM c""",
)
def label_audit(spark, folder):
    report = rounded(ops.label_audit(samples(spark, folder), "label"), "imbalance_ratio")
    entries = F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return report.withColumn("class_counts", F.concat_ws(",", entries))


@query(
    "label_audit_by_category",
    f"""WITH {SAMPLES}, c AS (
  SELECT CAST(grouping(lang) AS INTEGER) AS is_overall, lang, label, count(*) AS n
  FROM samples GROUP BY GROUPING SETS ((lang, label), (label)))
SELECT is_overall, lang, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_classes, {SQL_RATIO} AS imbalance_ratio
FROM c GROUP BY is_overall, lang""",
)
def label_audit_by_category(spark, folder):
    report = ops.label_audit_by(samples(spark, folder), "label", "lang")
    return rounded(report.withColumn("is_overall", F.col("is_overall").cast("int")), "imbalance_ratio")


@query(
    "defect_breakdown",
    "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type",
)
def defect_breakdown(spark, folder):
    return ops.breakdown(table(spark, folder, "part"), "p_brand", "p_type")


@query(
    "distinct_defect_types",
    "SELECT p_brand, count(DISTINCT p_type) AS n_kinds FROM part GROUP BY p_brand",
)
def distinct_defect_types(spark, folder):
    return ops.distinct_kinds(table(spark, folder, "part"), "p_brand", "p_type")


@query(
    "sketched_distinct_kinds",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact_kinds, count(DISTINCT year(l_shipdate)) AS n_loads, true AS within_error
FROM lineitem GROUP BY l_returnflag""",
)
def sketched_distinct_kinds(spark, folder):
    """Sketches stored per load (a year of shipping) and merged: within four standard errors of the exact count."""
    lines = table(spark, folder, "lineitem").withColumn("load", F.year("l_shipdate"))
    path = scratch_path(spark, "sketches")
    ops.kind_sketches(lines, ["load", "l_returnflag"], "l_orderkey").write.partitionBy("load").parquet(path)
    stored = spark.read.parquet(path)
    loads = stored.groupBy("l_returnflag").agg(F.countDistinct("load").alias("n_loads"))
    merged = ops.sketched_kinds(ops.merge_sketches(stored, ["l_returnflag"]))
    exact = ops.distinct_kinds(lines, "l_returnflag", "l_orderkey").withColumnRenamed("n_kinds", "exact_kinds")
    off = F.abs(F.col("n_kinds") - F.col("exact_kinds")) / F.col("exact_kinds")
    joined = exact.join(merged, "l_returnflag").join(loads, "l_returnflag")
    return joined.select("l_returnflag", "exact_kinds", "n_loads", (off <= 4 * ops.sketch_error()).alias("within_error"))


@query(
    "cohen_kappa",
    """WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (quality = toxic) AS same FROM labels),
a AS (SELECT quality AS label, count(*) AS n_a FROM labels GROUP BY quality),
b AS (SELECT toxic AS label, count(*) AS n_b FROM labels GROUP BY toxic),
s AS (SELECT same / n AS po, (SELECT sum(n_a * n_b) FROM a JOIN b USING (label)) / (n * n) AS pe, n FROM t)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS observed, round(pe, 6) AS expected,
       round((po - pe) / (1 - pe), 6) AS kappa FROM s""",
)
def cohen_kappa(spark, folder):
    return rounded(ops.cohen_kappa(table(spark, folder, "labels"), "quality", "toxic"), "observed", "expected", "kappa")


@query(
    "vector_norm_stats",
    """WITH x AS (SELECT unnest(embedding) AS v, unnest(range(0, 64)) AS dim FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean,
       round(stddev_pop(CAST(v AS DOUBLE)), 6) AS std FROM x GROUP BY dim""",
)
def vector_norm_stats(spark, folder):
    return rounded(ops.vector_stats(table(spark, folder, "embeddings"), "embedding"), "mean", "std")


@query(
    "flagged_share",
    """SELECT count(*) AS n_samples, count(l.doc_id) AS n_flagged,
       round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS flagged_fraction
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id""",
)
def flagged_share(spark, folder):
    flagged = table(spark, folder, "labels").filter("quality = 0")
    return rounded(ops.flagged_share(table(spark, folder, "documents"), flagged, "doc_id"), "flagged_fraction")
