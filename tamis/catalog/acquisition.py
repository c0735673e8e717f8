"""Choosing rows to label, revealing labels, and the loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import query, rounded, sql_code, sql_split, sql_uniform, sql_units, table
from tamis.catalog.noise import embeddings, probabilities, split_embeddings, sql_probs
from tamis.operators import acquire as ops
from tamis.operators.experiments import learning_curve
from tamis.functions.vectors import squared_distance, vector_sums
from tamis.functions.keyed import SEED
from tamis.operators.clusters import fit_clusters
from tamis.session import join_small, materialise

BATCH = 50
SQL_ENTROPY = "-sum(p * ln(p + 1e-12::DOUBLE))"
SQL_SCORES = f"""scores AS (
  SELECT vec_id, {SQL_ENTROPY} AS entropy, 1.0 - max(p) AS least_confidence,
         1.0 - (max(p, 2)[1] - max(p, 2)[2]) AS margin FROM probs GROUP BY vec_id)"""


def sql_top(score: str, source: str, k: int = BATCH) -> str:
    return f"""SELECT vec_id, round({score}, 6) AS score,
       row_number() OVER (ORDER BY {sql_units(score)} DESC, {sql_code('tie', 'vec_id')}) AS pick
FROM {source} QUALIFY pick <= {k}"""


def most_uncertain(spark, folder, method):
    return rounded(ops.most_uncertain(probabilities(spark, folder), "vec_id", "probs", BATCH, method), "score")


@query("uncertain_by_entropy", f"WITH {sql_probs()}, {SQL_SCORES} {sql_top('entropy', 'scores')}")
def uncertain_by_entropy(spark, folder):
    return most_uncertain(spark, folder, "entropy")


@query("uncertain_by_confidence", f"WITH {sql_probs()}, {SQL_SCORES} {sql_top('least_confidence', 'scores')}")
def uncertain_by_confidence(spark, folder):
    return most_uncertain(spark, folder, "least_confidence")


@query("uncertain_by_margin", f"WITH {sql_probs()}, {SQL_SCORES} {sql_top('margin', 'scores')}")
def uncertain_by_margin(spark, folder):
    return most_uncertain(spark, folder, "margin")


@query("kmeans_clusters")
def kmeans_clusters(spark, folder):
    return rounded(ops.cluster(embeddings(spark, folder), "vec_id", "embedding"), "distance")


@query("kmeans_clusters_check", "SELECT vec_id, true AS nearest, true AS best_start FROM embeddings WHERE embedding IS NOT NULL")
def kmeans_clusters_check(spark, folder):
    """Every row once: no centre is nearer than its own, and no single start costs less."""
    rows = materialise(embeddings(spark, folder).select("vec_id", "embedding"))
    best = fit_clusters(rows, "vec_id", "embedding", ops.CLUSTERS, SEED, ops.RESTARTS, 20)
    assigned = ops.assign(rows, "vec_id", "embedding", best.centres)
    cost = assigned.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.centres])
    least = F.array_min(F.transform(centres, lambda c: squared_distance("embedding", c)))
    return rows.join(assigned, "vec_id").select(
        "vec_id", (F.col("distance") <= F.sqrt(least) + 1e-9).alias("nearest"), F.lit(bool(cost <= best.costs.min() * (1 + 1e-9))).alias("best_start")
    )


# Given assignments: the label stands for the cluster, its mean for the centre.
SQL_ASSIGNED = """parts AS (
  SELECT vec_id, label AS cluster, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM embeddings),
middles AS (SELECT cluster, dim, avg(x) AS c FROM parts GROUP BY cluster, dim),
assigned AS (
  SELECT vec_id, cluster, round(sqrt(sum((x - c) * (x - c))), 9) AS distance
  FROM parts JOIN middles USING (cluster, dim) GROUP BY vec_id, cluster),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY %s, %s) AS turn FROM assigned)""" % (
    sql_units("distance"),
    sql_code("tie", "vec_id"),
)


def assigned(spark, folder):
    rows = embeddings(spark, folder).withColumnRenamed("label", "cluster")
    sums = vector_sums(rows, ["cluster"], "embedding")
    centres = sums.select("cluster", F.transform("sums", lambda s: s / F.col("n")).alias("_centre"))
    distance = F.round(F.sqrt(squared_distance("embedding", "_centre")), 9)
    return join_small(rows, centres, "cluster").select("vec_id", "cluster", distance.alias("distance"))


@query(
    "cluster_representatives",
    f"""WITH {SQL_ASSIGNED}
SELECT vec_id, cluster, row_number() OVER (ORDER BY cluster) AS pick FROM turns WHERE turn = 1 QUALIFY pick <= {BATCH}""",
)
def cluster_representatives(spark, folder):
    return ops.cluster_representatives(assigned(spark, folder), "vec_id", BATCH)


@query(
    "cluster_representatives_cycling",
    f"""WITH {SQL_ASSIGNED}
SELECT vec_id, cluster, row_number() OVER (ORDER BY turn, cluster) AS pick FROM turns QUALIFY pick <= {BATCH}""",
)
def cluster_representatives_cycling(spark, folder):
    return ops.cluster_representatives(assigned(spark, folder), "vec_id", BATCH, cycle=True)


@query(
    "hybrid_sampling",
    f"""WITH {sql_probs()}, {SQL_ASSIGNED}, raw AS (
  SELECT vec_id, u, distance AS d FROM assigned
  JOIN (SELECT vec_id, {SQL_ENTROPY} AS u FROM probs GROUP BY vec_id) USING (vec_id)),
blended AS (
  SELECT vec_id, 0.7::DOUBLE * (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ())
               + 0.3::DOUBLE * (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS score FROM raw)
{sql_top('score', 'blended')}""",
)
def hybrid_sampling(spark, folder):
    rows = assigned(spark, folder).join(probabilities(spark, folder).select("vec_id", "probs"), "vec_id")
    return rounded(ops.hybrid(rows, "vec_id", "probs", "distance", BATCH), "score")


@query(
    "reveal_labels",
    f"""WITH picked AS (SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0),
class_list AS (SELECT list_sort(list(DISTINCT label)) AS cs FROM embeddings),
choices AS (
  SELECT vec_id, label, list_filter((SELECT cs FROM class_list), lambda c: c <> label) AS rest FROM picked)
SELECT vec_id, CASE WHEN {sql_uniform('annotator', 'vec_id')} < 0.2::DOUBLE
                    THEN rest[CAST(floor({sql_uniform('annotator class', 'vec_id')} * len(rest)) AS BIGINT) + 1]
                    ELSE label END AS label FROM choices""",
)
def reveal_labels(spark, folder):
    pool = embeddings(spark, folder)
    picked = pool.filter(F.col("embedding")[0] > 0)
    return ops.reveal_labels(pool, picked, "vec_id", "label", 0.2).select("vec_id", "label")


@query(
    "next_batch",
    f"""WITH {sql_split('embeddings', 'vec_id')}, train_rows AS (SELECT * FROM parted WHERE split = 'train'),
pool_part AS (SELECT * FROM parted WHERE split = 'val'),
fit_parts AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM train_rows),
fitted AS (SELECT label AS class, dim, avg(x) AS c FROM fit_parts GROUP BY label, dim),
pool_parts AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM pool_part),
logits AS (
  SELECT vec_id, class, -10.0::DOUBLE * sum((x - c) * (x - c)) AS z FROM pool_parts JOIN fitted USING (dim) GROUP BY vec_id, class),
weights AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits),
probs AS (SELECT vec_id, class, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM weights), {SQL_SCORES}
{sql_top('entropy', 'scores')}""",
)
def next_batch(spark, folder):
    """One round of labelling: fit on the train rows, score the pool (the val rows), choose."""
    parted = split_embeddings(spark, folder)
    picked = ops.next_batch(parted.filter("split = 'train'"), parted.filter("split = 'val'"), "vec_id", "label", "embedding", BATCH)
    return rounded(picked, "score")


# Histories of two labelling strategies, read off the events: a round is a day.
SQL_HISTORY = """rounds AS (
  SELECT event_type, CAST(ts AS DATE) - DATE '2024-01-01' AS round, count(*) AS fresh, avg(value) / 500.0 AS f1
  FROM events GROUP BY event_type, CAST(ts AS DATE) - DATE '2024-01-01')"""


def day_history(spark, folder, event_type):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    days = (
        table(spark, folder, "events")
        .filter(F.col("event_type") == event_type)
        .groupBy(day.alias("round"))
        .agg(F.count("*").alias("n_labeled"), (F.avg("value") / 500.0).alias("val_f1"))
    )
    return days


@query(
    "learning_curve",
    f"""WITH {SQL_HISTORY},
a AS (SELECT fresh AS n_labeled, max(f1) AS f1_active FROM rounds WHERE event_type = 'click' GROUP BY fresh),
b AS (SELECT fresh AS n_labeled, max(f1) AS f1_random FROM rounds WHERE event_type = 'purchase' GROUP BY fresh)
SELECT n_labeled, round(f1_active, 6) AS f1_active, round(f1_random, 6) AS f1_random,
       round(f1_active - f1_random, 6) AS gain FROM a FULL JOIN b USING (n_labeled)""",
)
def curve(spark, folder):
    def best(event_type):
        return day_history(spark, folder, event_type).groupBy("n_labeled").agg(F.max("val_f1").alias("val_f1"))

    return rounded(learning_curve(best("click"), best("purchase")), "f1_active", "f1_random", "gain")


@query(
    "stop_round",
    """WITH days AS (
  SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS round, count(*) AS fresh FROM events GROUP BY 1),
grown AS (SELECT round, sum(fresh) OVER (ORDER BY round) AS n_labeled FROM days)
SELECT min(round) AS stop_round FROM grown
WHERE round >= 29 OR n_labeled / CAST((SELECT count(*) FROM events) AS DOUBLE) >= 0.6::DOUBLE""",
)
def stop_round(spark, folder):
    from pyspark.sql import Window

    events = table(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    days = events.groupBy(day.alias("round")).agg(F.count("*").alias("fresh"))
    # One row per day.
    so_far = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    history = days.select("round", F.sum("fresh").over(so_far).alias("n_labeled"))
    return ops.stop_round(history, events.count(), 0, max_rounds=30)
