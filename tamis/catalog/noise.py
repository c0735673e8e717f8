"""Out-of-sample probabilities, confident learning, correction, noise injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import SAMPLES, query, rounded, samples, sql_code, sql_split, sql_uniform, sql_units, table
from tamis.operators import label_noise as ops
from tamis.operators.cleaning import select_split
from tamis.operators.splits import stratified_split
from tamis.plans.curation import noise_corrected, validate_detector
from tamis.session import materialise


def sql_probs(source: str = "embeddings") -> str:
    """CTEs ending in ``probs`` (vec_id, label, fold, class, p) for the rows of ``source``."""
    return f"""folded AS (
  SELECT vec_id, label, embedding,
         CAST(ntile(5) OVER (PARTITION BY label ORDER BY {sql_code('fold', 'vec_id')}) - 1 AS INTEGER) AS fold
  FROM {source}),
components AS (
  SELECT vec_id, label, fold, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM folded),
per_fold AS (
  SELECT fold, label, dim, sum(x) AS s, count(*) AS n FROM components GROUP BY fold, label, dim),
overall AS (SELECT label, dim, sum(s) AS s, sum(n) AS n FROM per_fold GROUP BY label, dim),
folds AS (SELECT DISTINCT fold FROM folded),
centres AS (
  SELECT f.fold, o.label AS class, o.dim,
         (o.s - coalesce(p.s, 0)) / CAST(o.n - coalesce(p.n, 0) AS DOUBLE) AS c
  FROM folds f CROSS JOIN overall o
  LEFT JOIN per_fold p ON p.fold = f.fold AND p.label = o.label AND p.dim = o.dim
  WHERE o.n > coalesce(p.n, 0)),
logits AS (
  SELECT v.vec_id, v.label, v.fold, c.class, -10.0::DOUBLE * sum((v.x - c.c) * (v.x - c.c)) AS z
  FROM components v JOIN centres c ON v.fold = c.fold AND v.dim = c.dim
  GROUP BY v.vec_id, v.label, v.fold, c.class),
weights AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits),
probs AS (
  SELECT vec_id, label, fold, class, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM weights)"""


# From ``probs`` to ``flagged`` (vec_id) by the default pruning rule.
SQL_JOINT = """own AS (SELECT vec_id, label, p AS p_own FROM probs WHERE class = label),
thresholds AS (SELECT label AS class, round(avg(p_own), 9) AS t, count(*) AS n FROM own GROUP BY label),
best AS (
  SELECT vec_id, label, min_by(class, (-p, class)) AS suggested
  FROM probs JOIN thresholds USING (class) WHERE p >= t GROUP BY vec_id, label),
cells AS (SELECT label, suggested, count(*) AS n FROM best GROUP BY label, suggested),
filled AS (
  SELECT * FROM cells UNION ALL
  SELECT class, class, n FROM thresholds WHERE class NOT IN (SELECT label FROM cells)),
joint AS (
  SELECT f.label, f.suggested, f.n, f.n / CAST(sum(f.n) OVER (PARTITION BY f.label) AS DOUBLE) * t.n AS calibrated
  FROM filled f JOIN thresholds t ON f.label = t.class),
quotas AS (SELECT *, CAST(floor(calibrated + 0.5::DOUBLE) AS BIGINT) AS quota FROM joint),
ranked AS (SELECT vec_id, label, min_by(class, (-p, class)) AS argmax FROM probs GROUP BY vec_id, label)"""

SQL_PBNR = f"""gaps AS (
  SELECT p.vec_id, p.label, p.class,
         row_number() OVER (PARTITION BY p.label, p.class
                            ORDER BY {sql_units('p.p - o.p_own')} DESC, {sql_code('tie', 'p.vec_id')}) AS place
  FROM probs p JOIN own o USING (vec_id) WHERE p.class <> p.label),
noise_rate AS (
  SELECT DISTINCT g.vec_id FROM gaps g JOIN quotas q ON g.label = q.label AND g.class = q.suggested
  WHERE g.place <= q.quota)"""

SQL_PBC = f"""off AS (
  SELECT label, CAST(floor(sum(CASE WHEN label <> suggested THEN calibrated ELSE 0 END) + 0.5::DOUBLE) AS BIGINT) AS quota
  FROM joint GROUP BY label),
by_class AS (
  SELECT vec_id FROM (
    SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_units('p_own')}, {sql_code('tie', 'vec_id')}) AS place
    FROM own) JOIN off USING (label) WHERE place <= quota)"""

SQL_DISAGREE = "SELECT vec_id FROM ranked WHERE argmax <> label"


def sql_flagged(method: str) -> str:
    listed = {
        "pbnr": "SELECT vec_id FROM noise_rate",
        "pbc": "SELECT vec_id FROM by_class",
        "both": "SELECT vec_id FROM noise_rate INTERSECT SELECT vec_id FROM by_class",
        "confident_joint": "SELECT vec_id FROM best WHERE suggested <> label",
    }[method]
    return f"{SQL_JOINT}, {SQL_PBNR}, {SQL_PBC}, flagged AS (({listed}) INTERSECT ({SQL_DISAGREE}))"


SQL_SCORES = """others AS (SELECT vec_id, max(p) AS p_other FROM probs WHERE class <> label GROUP BY vec_id),
entropies AS (SELECT vec_id, -sum(p * ln(p + 1e-12::DOUBLE)) AS h, count(*) AS k FROM probs GROUP BY vec_id),
severity AS (
  SELECT vec_id, label, p_own AS self_confidence, (p_own - p_other + 1.0) / 2.0 AS normalized_margin,
         h / (ln(CAST(k AS DOUBLE)) * greatest(p_own, 1e-6::DOUBLE)) AS confidence_weighted_entropy
  FROM own JOIN others USING (vec_id) JOIN entropies USING (vec_id))"""


def sql_issues(rank_by: str, method: str = "pbnr", source: str = "embeddings") -> str:
    order = "DESC" if rank_by == "confidence_weighted_entropy" else "ASC"
    return f"""WITH {sql_probs(source)}, {sql_flagged(method)}, {SQL_SCORES}
SELECT vec_id, label, round({rank_by}, 6) AS score,
       row_number() OVER (ORDER BY {sql_units(rank_by)} {order}, {sql_code('tie', 'vec_id')}) AS issue_rank
FROM severity WHERE vec_id IN (SELECT vec_id FROM flagged)"""


def embeddings(spark, folder):
    return table(spark, folder, "embeddings")


def probabilities(spark, folder):
    """Materialised out-of-sample probabilities of all embeddings."""
    return materialise(ops.oos_probabilities(embeddings(spark, folder), "vec_id", "label", "embedding"))


def issues(spark, folder, rank_by="self_confidence", method="pbnr"):
    found = ops.label_issues(probabilities(spark, folder), "vec_id", "label", "probs", method, rank_by)
    return rounded(found, "score")


@query(
    "oos_probabilities",
    f"""WITH {sql_probs()}
SELECT vec_id, fold, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM probs""",
)
def oos_probabilities(spark, folder):
    scored = ops.oos_probabilities(embeddings(spark, folder), "vec_id", "label", "embedding")
    long = scored.select("vec_id", "fold", F.posexplode("probs").alias("class", "p"))
    return rounded(long, "p")


# Labels that neither count from 0 nor are without gaps.
SQL_GAPPED = """gapped AS (SELECT vec_id, embedding, CAST(label * label + 3 AS INTEGER) AS label FROM embeddings WHERE label <> 4)"""


@query(
    "label_issues_gapped_labels",
    sql_issues("self_confidence", source="gapped").replace("WITH ", f"WITH {SQL_GAPPED}, ", 1),
)
def label_issues_gapped_labels(spark, folder):
    rows = embeddings(spark, folder).filter("label <> 4").withColumn("label", (F.col("label") * F.col("label") + 3).cast("int"))
    scored = materialise(ops.oos_probabilities(rows, "vec_id", "label", "embedding"))
    return rounded(ops.label_issues(scored, "vec_id", "label"), "score")


@query("oos_probabilities_logistic")
def oos_probabilities_logistic(spark, folder):
    return ops.oos_probabilities_logistic(
        embeddings(spark, folder), "vec_id", "label", "embedding"
    )


@query(
    "oos_probabilities_logistic_check",
    f"""WITH {sql_probs()}
SELECT DISTINCT vec_id, label, fold, CAST((SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS n_classes,
       1.0::DOUBLE AS total FROM probs""",
)
def oos_probabilities_logistic_check(spark, folder):
    """Every row once, in its fold, with a probability for each class that sum to one."""
    scored = ops.oos_probabilities_logistic(embeddings(spark, folder), "vec_id", "label", "embedding")
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return rounded(scored.select("vec_id", "label", "fold", F.size("probs").alias("n_classes"), total.alias("total")), "total")


@query(
    "class_thresholds",
    f"""WITH {sql_probs()}, {SQL_JOINT} SELECT class AS label, n, round(t, 6) AS threshold FROM thresholds""",
)
def class_thresholds(spark, folder):
    scored = ops.oos_probabilities(embeddings(spark, folder), "vec_id", "label", "embedding")
    return rounded(ops.class_thresholds(scored, "label"), "threshold")


@query(
    "confident_joint",
    f"""WITH {sql_probs()}, {SQL_JOINT}
SELECT label, suggested, n, round(calibrated, 6) AS calibrated, quota FROM quotas""",
)
def confident_joint(spark, folder):
    return rounded(ops.confident_joint(probabilities(spark, folder), "label"), "calibrated")


@query("label_issues", sql_issues("self_confidence"))
def label_issues(spark, folder):
    return issues(spark, folder)


@query("label_issues_by_margin", sql_issues("normalized_margin"))
def label_issues_by_margin(spark, folder):
    return issues(spark, folder, "normalized_margin")


@query("label_issues_by_entropy", sql_issues("confidence_weighted_entropy"))
def label_issues_by_entropy(spark, folder):
    return issues(spark, folder, "confidence_weighted_entropy")


@query("label_issues_by_class", sql_issues("self_confidence", "pbc"))
def label_issues_by_class(spark, folder):
    return issues(spark, folder, method="pbc")


@query("label_issues_both_rules", sql_issues("self_confidence", "both"))
def label_issues_both_rules(spark, folder):
    return issues(spark, folder, method="both")


@query("label_issues_off_diagonal", sql_issues("self_confidence", "confident_joint"))
def label_issues_off_diagonal(spark, folder):
    return issues(spark, folder, method="confident_joint")


@query(
    "remove_flagged",
    f"""WITH {sql_probs()}, {sql_flagged('pbnr')}
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM flagged)""",
)
def remove_flagged(spark, folder):
    return ops.remove_flagged(embeddings(spark, folder), issues(spark, folder), "vec_id").select("vec_id", "label")


def relabelled(spark, folder, min_confidence=None):
    scored = probabilities(spark, folder)
    found = ops.label_issues(scored, "vec_id", "label")
    rows = embeddings(spark, folder).select("vec_id", "label")
    return ops.relabel_flagged(rows, found, scored, "vec_id", "label", min_confidence)


@query(
    "relabel_flagged",
    f"""WITH {sql_probs()}, {sql_flagged('pbnr')}
SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM flagged) THEN argmax ELSE label END AS label FROM ranked""",
)
def relabel_flagged(spark, folder):
    return relabelled(spark, folder)


@query(
    "relabel_flagged_if_sure",
    f"""WITH {sql_probs()}, {sql_flagged('pbnr')},
sure AS (SELECT vec_id FROM probs GROUP BY vec_id HAVING max(p) >= 0.3::DOUBLE)
SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM flagged) AND vec_id IN (SELECT vec_id FROM sure)
                    THEN argmax ELSE label END AS label FROM ranked""",
)
def relabel_flagged_if_sure(spark, folder):
    return relabelled(spark, folder, 0.3)


def sql_noise(source: str, key: str, classes: str) -> str:
    """CTE ``noisy``: ``source`` (with split) after flipping a tenth of its train labels."""
    return f"""quota AS (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS q FROM {source} WHERE split = 'train'),
class_list AS (SELECT list_sort(list(DISTINCT {classes})) AS cs FROM {source}),
numbered AS (
  SELECT s.*, row_number() OVER (PARTITION BY split = 'train' ORDER BY {sql_code('noise', key)}) AS noise_place
  FROM {source} s),
chosen AS (
  SELECT *, split = 'train' AND noise_place <= (SELECT q FROM quota) AS is_synthetically_noisy,
         list_filter((SELECT cs FROM class_list), lambda c: c <> {classes}) AS rest FROM numbered),
noisy AS (
  SELECT * EXCLUDE (noise_place, rest, {classes}),
         CASE WHEN is_synthetically_noisy
              THEN rest[CAST(floor({sql_uniform('noise class', key)} * len(rest)) AS BIGINT) + 1]
              ELSE {classes} END AS {classes} FROM chosen)"""


@query(
    "inject_label_noise",
    f"""WITH {SAMPLES}, {sql_split('samples')}, {sql_noise('parted', 'doc_id', 'label')}
SELECT doc_id, label, split, is_synthetically_noisy FROM noisy""",
)
def inject_label_noise(spark, folder):
    manifest = stratified_split(samples(spark, folder).select("doc_id", "label"), "doc_id", "label")
    return ops.inject_label_noise(manifest, "doc_id", "label")


@query(
    "score_detector",
    """WITH c AS (
  SELECT count(*) FILTER (toxic = 1) AS injected, count(*) FILTER (quality = 0) AS flagged,
         count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fp,
         count(*) FILTER (quality <> 0 AND toxic = 1) AS fn FROM labels)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall FROM c""",
)
def score_detector(spark, folder):
    marks = table(spark, folder, "labels").select((F.col("quality") == 0).alias("f"), (F.col("toxic") == 1).alias("t"))
    return rounded(ops.score_detector(marks, "f", "t"), "precision", "recall")


def split_embeddings(spark, folder):
    return stratified_split(embeddings(spark, folder), "vec_id", "label")


@query(
    "noise_corrected",
    f"""WITH {sql_split('embeddings', 'vec_id')}, train_rows AS (SELECT * FROM parted WHERE split = 'train'),
{sql_probs('train_rows')}, {sql_flagged('pbnr')}
SELECT vec_id, label, split FROM parted WHERE vec_id NOT IN (SELECT vec_id FROM flagged)""",
)
def noise_corrected_manifest(spark, folder):
    manifest = noise_corrected(split_embeddings(spark, folder), "vec_id", "label", "embedding")
    return manifest.select("vec_id", "label", "split")


@query(
    "validate_noise_detection",
    f"""WITH {sql_split('embeddings', 'vec_id')}, {sql_noise('parted', 'vec_id', 'label')},
train_rows AS (SELECT * FROM noisy WHERE split = 'train'),
{sql_probs('train_rows')}, {sql_flagged('pbnr')},
c AS (
  SELECT count(*) FILTER (is_synthetically_noisy) AS injected, count(f.vec_id) AS flagged,
         count(f.vec_id) FILTER (is_synthetically_noisy) AS tp,
         count(f.vec_id) FILTER (NOT is_synthetically_noisy) AS fp,
         count(*) FILTER (is_synthetically_noisy AND f.vec_id IS NULL) AS fn
  FROM train_rows t LEFT JOIN flagged f ON t.vec_id = f.vec_id)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall FROM c""",
)
def validate_noise_detection(spark, folder):
    result = validate_detector(split_embeddings(spark, folder), "vec_id", "label", "embedding")
    return rounded(result, "precision", "recall")


@query(
    "evaluate_probe",
    f"""WITH {sql_split('embeddings', 'vec_id')},
components AS (SELECT vec_id, label, split, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM parted),
centres AS (SELECT label AS class, dim, avg(x) AS c FROM components WHERE split = 'train' GROUP BY label, dim),
logits AS (
  SELECT v.vec_id, v.label, c.class, -10.0::DOUBLE * sum((v.x - c.c) * (v.x - c.c)) AS z
  FROM components v JOIN centres c USING (dim) WHERE v.split = 'test' GROUP BY v.vec_id, v.label, c.class),
weights AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits),
probs AS (SELECT vec_id, label, class, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM weights)
SELECT vec_id, label, CAST(min_by(class, (-p, class)) AS INTEGER) AS prediction,
       round(max(p) FILTER (class = 1), 6) AS positive_prob
FROM probs GROUP BY vec_id, label""",
)
def evaluate_probe(spark, folder):
    from tamis.operators.acquire import centroid_scorer
    from tamis.operators.metrics import predictions

    parted = split_embeddings(spark, folder)
    train = select_split(parted, "train")
    classes = ops.class_list(train, "label")
    scorer = centroid_scorer(train, "label", "embedding", classes)
    scored = predictions(scorer(select_split(parted, "test")), "vec_id", "label", "probs", classes=classes)
    return rounded(scored, "positive_prob")
