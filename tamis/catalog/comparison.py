"""Prediction metrics, early stopping, run log and statistics over runs.

Runs come from the events: a condition is an event type, a run the users of one
remainder class, its metric their mean value.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis.catalog import query, rounded, sql_split, sql_uniform, table
from tamis.catalog.noise import probabilities, split_embeddings, sql_probs
from tamis.functions.keyed import SEED
from tamis.functions.vectors import argmax_index
from tamis.operators import experiments, metrics
from tamis.operators.softmax import TOLERANCE
from tamis.plans import curation
from tamis.session import scratch_path
from tamis.sources import runs as log

EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]

SQL_RUNS = """runs AS (
  SELECT 'events' AS experiment, event_type AS condition, CAST(user_id % 5 AS INTEGER) AS run_index,
         42 + user_id % 5 AS run_seed, 'test_f1' AS metric, avg(value) / 500.0::DOUBLE AS value
  FROM events GROUP BY event_type, user_id % 5)"""
# The 97.5 % point of Student's t with four degrees of freedom; fixed value.
SQL_T4 = "2.7764451051977987::DOUBLE"


def event_runs(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 5).cast("int").alias("run_index"))
        .agg((F.avg("value") / 500.0).alias("value"))
        .select(
            F.lit("events").alias("experiment"),
            "condition",
            "run_index",
            (F.lit(42) + F.col("run_index")).cast("bigint").alias("run_seed"),
            F.lit("test_f1").alias("metric"),
            "value",
        )
    )


@query(
    "run_log_round_trip",
    f"WITH {SQL_RUNS} SELECT * REPLACE (round(value, 6) AS value) FROM runs WHERE condition = 'click'",
)
def run_log_round_trip(spark, folder):
    path = scratch_path(spark, "runs")
    log.append_runs(event_runs(spark, folder), path, EVENT_TYPES)
    return rounded(log.read_runs(spark, path, "events", "click"), "value")


@query(
    "present_metrics",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events
WHERE value >= 1 AND value < 200 GROUP BY event_type""",
)
def present_metrics(spark, folder):
    value = F.when(F.col("value") >= 200, F.lit(float("nan"))).when(F.col("value") >= 1, F.col("value"))
    known = log.present(table(spark, folder, "events").withColumn("value", value))
    return rounded(known.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query(
    "metrics_wide",
    """SELECT 'events' AS experiment, event_type AS condition, CAST(user_id % 5 AS INTEGER) AS run_index,
       round(avg(value), 6) AS val_mean, round(max(value), 6) AS val_max
FROM events GROUP BY event_type, user_id % 5""",
)
def metrics_wide(spark, folder):
    keys = ["experiment", "condition", "run_index"]
    wide = (
        table(spark, folder, "events")
        .groupBy(
            F.lit("events").alias("experiment"),
            F.col("event_type").alias("condition"),
            (F.col("user_id") % 5).cast("int").alias("run_index"),
        )
        .agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    )
    long = log.metrics_to_long(wide, keys, "val_")
    return rounded(log.metrics_to_wide(long, ["val_mean", "val_max"]), "val_mean", "val_max")


@query(
    "metrics_long",
    """WITH wide AS (
  SELECT event_type AS condition, avg(value) AS mean, max(value) AS max FROM events GROUP BY event_type)
SELECT condition, 'test_mean' AS metric, round(mean, 6) AS value FROM wide
UNION ALL SELECT condition, 'test_max', round(max, 6) FROM wide""",
)
def metrics_long(spark, folder):
    wide = table(spark, folder, "events").groupBy(F.col("event_type").alias("condition"))
    wide = wide.agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return rounded(log.metrics_to_long(wide, ["condition"], "test_"), "value")


# --- prediction metrics ------------------------------------------------------------

SQL_PREDICTED = f"""{sql_probs()}, predicted AS (
  SELECT vec_id, label, min_by(class, (-p, class)) AS prediction, max(p) FILTER (class = 1) AS positive_prob,
         max(p) FILTER (class = label) AS p_own FROM probs GROUP BY vec_id, label)"""

SQL_BINARY = """counts AS (
  SELECT count(*) AS n, count(*) FILTER (label = prediction) AS same,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (label <> 1 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction <> 1) AS fn FROM predicted)"""


def sql_ratio(top: str, bottom: str) -> str:
    return f"round(CASE WHEN {bottom} > 0 THEN ({top}) / CAST({bottom} AS DOUBLE) ELSE 0 END, 6)"


SQL_BINARY_COLUMNS = f"""{sql_ratio('same', 'n')} AS accuracy, {sql_ratio('tp', '(tp + fp)')} AS precision,
       {sql_ratio('tp', '(tp + fn)')} AS recall, {sql_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1"""


@query("binary_metrics", f"WITH {SQL_PREDICTED}, {SQL_BINARY} SELECT n, {SQL_BINARY_COLUMNS} FROM counts")
def binary_metrics(spark, folder):
    scored = probabilities(spark, folder).withColumn("prediction", argmax_index("probs"))
    return rounded(metrics.binary_metrics(scored, "label", "prediction"), "accuracy", "precision", "recall", "f1")


@query(
    "binary_metrics_by_type",
    f"""WITH predicted AS (
  SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction FROM lineitem),
counts AS (
  SELECT l_linestatus, count(*) AS n, count(*) FILTER (label = prediction) AS same,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM predicted GROUP BY l_linestatus)
SELECT l_linestatus, n, {SQL_BINARY_COLUMNS} FROM counts""",
)
def binary_metrics_by_type(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("prediction"),
    )
    by_type = metrics.binary_metrics(lines, "label", "prediction", ["l_linestatus"])
    return rounded(by_type, "accuracy", "precision", "recall", "f1")


def sql_auroc(source: str) -> str:
    """AUROC by mid-ranks of ``source`` (label, score)."""
    return f"""ranked AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM {source}),
totals AS (
  SELECT sum(mid) FILTER (label = 1) AS s, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p,
         CAST(count(*) FILTER (label <> 1) AS DOUBLE) AS n FROM ranked)
SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM totals"""


@query(
    "metric_suite",
    f"""WITH {SQL_PREDICTED}, {SQL_BINARY}, scored AS (SELECT label, positive_prob AS score FROM predicted),
area AS (WITH {sql_auroc('scored')})
SELECT (SELECT round(avg(-ln(greatest(p_own, 1e-12::DOUBLE))), 6) FROM predicted) AS loss,
       {SQL_BINARY_COLUMNS}, (SELECT auroc FROM area) AS auroc FROM counts""",
)
def metric_suite(spark, folder):
    suite = metrics.evaluate(probabilities(spark, folder), "vec_id", "label")
    return rounded(suite, *suite.columns)


@query(
    "auroc",
    f"WITH {SQL_PREDICTED}, scored AS (SELECT label, positive_prob AS score FROM predicted), {sql_auroc('scored')}",
)
def auroc(spark, folder):
    scored = probabilities(spark, folder).withColumn("score", F.col("probs")[1])
    return rounded(metrics.auroc(scored, "label", "score"), "auroc")


@query(
    "auroc_large",
    f"""WITH scored AS (
  SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, round(value / (value + 50.0::DOUBLE), 9) AS score FROM events),
{sql_auroc('scored')}""",
)
def auroc_large(spark, folder):
    scored = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), (F.col("value") / (F.col("value") + 50.0)).alias("score")
    )
    return rounded(metrics.auroc(scored, "label", "score"), "auroc")


@query(
    "cross_entropy",
    f"WITH {SQL_PREDICTED} SELECT round(avg(-ln(greatest(p_own, 1e-12::DOUBLE))), 6) AS loss FROM predicted",
)
def cross_entropy(spark, folder):
    return rounded(metrics.cross_entropy(probabilities(spark, folder), "label", "probs"), "loss")


@query(
    "early_stop",
    """WITH days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, avg(value) / 500.0::DOUBLE AS f1 FROM events GROUP BY user_id, CAST(ts AS DATE)),
history AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS epoch, f1 FROM days),
marked AS (
  SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY user_id ORDER BY epoch
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AND f1 > 0 AS better FROM history),
lasting AS (
  SELECT *, coalesce(max(epoch) FILTER (better) OVER (PARTITION BY user_id ORDER BY epoch), -1) AS last_better FROM marked),
stops AS (SELECT user_id, min(epoch) FILTER (epoch - last_better >= 5) AS stopped_at FROM lasting GROUP BY user_id)
SELECT l.user_id, CAST(coalesce(max(epoch) FILTER (better), 0) AS INTEGER) AS best_epoch,
       round(coalesce(max(f1) FILTER (better), 0), 6) AS best_f1, CAST(max(stopped_at) AS INTEGER) AS stopped_at
FROM lasting l JOIN stops s ON l.user_id = s.user_id
WHERE stopped_at IS NULL OR epoch <= stopped_at GROUP BY l.user_id""",
)
def early_stop(spark, folder):
    events = table(spark, folder, "events")
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.avg("value") / 500.0).alias("f1"))
    # One row per user and day is left.
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1
    return rounded(metrics.early_stop(days.withColumn("epoch", epoch), "user_id", "epoch", "f1"), "best_f1")


# --- runs --------------------------------------------------------------------------


@query(
    "run_summary",
    f"""WITH {SQL_RUNS}
SELECT condition, count(*) AS n_runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max FROM runs GROUP BY condition""",
)
def run_summary(spark, folder):
    return rounded(experiments.run_summary(event_runs(spark, folder)), "mean", "std", "min", "max")


SQL_COMPARED = f"""{SQL_RUNS}, compared AS (
  SELECT condition, count(*) AS n_runs, avg(value) AS mean, stddev_samp(value) AS std,
         {SQL_T4} * stddev_samp(value) / sqrt(count(*)) AS half FROM runs GROUP BY condition)"""
SQL_COMPARISON = f"""WITH {SQL_COMPARED}
SELECT condition, n_runs, round(mean, 6) AS mean, round(std, 6) AS std,
       round(mean - half, 6) AS ci_low, round(mean + half, 6) AS ci_high FROM compared"""


@query("comparison_table", SQL_COMPARISON)
def comparison_table(spark, folder):
    compared = experiments.comparison_table(event_runs(spark, folder), conditions=EVENT_TYPES)
    return rounded(compared, "mean", "std", "ci_low", "ci_high")


@query("comparison_csv_round_trip", SQL_COMPARISON)
def comparison_csv_round_trip(spark, folder):
    path = scratch_path(spark, "comparison.csv")
    log.write_comparison(experiments.comparison_table(event_runs(spark, folder), conditions=EVENT_TYPES), path)
    schema = "condition string, n_runs bigint, mean double, std double, ci_low double, ci_high double"
    return rounded(spark.read.schema(schema).csv(path, header=True), "mean", "std", "ci_low", "ci_high")


@query(
    "error_bars",
    f"""WITH {SQL_COMPARED} SELECT condition, round(mean, 6) AS mean, round(half, 6) AS error_low, round(half, 6) AS error_high
FROM compared""",
)
def error_bars(spark, folder):
    compared = experiments.comparison_table(event_runs(spark, folder), conditions=EVENT_TYPES)
    return rounded(experiments.error_bars(compared), "mean", "error_low", "error_high")


@query(
    "significance_test",
    f"""WITH {SQL_RUNS}, s AS (
  SELECT avg(value) FILTER (condition = 'click') AS ma, var_samp(value) FILTER (condition = 'click') AS va,
         avg(value) FILTER (condition = 'view') AS mb, var_samp(value) FILTER (condition = 'view') AS vb FROM runs),
t AS (SELECT *, (ma - mb) / sqrt((4 * va + 4 * vb) / 8 * (0.2::DOUBLE + 0.2::DOUBLE)) AS t FROM s),
angle AS (SELECT *, sin(atan(abs(t) / sqrt(8.0::DOUBLE))) AS si, power(cos(atan(abs(t) / sqrt(8.0::DOUBLE))), 2) AS c2 FROM t)
SELECT 'click' AS condition_a, round(ma, 6) AS mean_a, 'view' AS condition_b, round(mb, 6) AS mean_b,
       round(t, 6) AS t_statistic, round(1 - si * (1 + c2 / 2 + 3 * c2 * c2 / 8 + 15 * c2 * c2 * c2 / 48), 6) AS p_value
FROM angle""",
)
def significance_test(spark, folder):
    tested = experiments.significance_test(event_runs(spark, folder), "click", "view")
    return rounded(tested, "mean_a", "mean_b", "t_statistic", "p_value")


@query("run_condition")
def run_condition(spark, folder):
    runs = experiments.run_condition(
        split_embeddings(spark, folder), "baseline", "vec_id", "label", "embedding", "probe"
    )
    return rounded(runs, "value")


BOOTSTRAP_RUNS = 5
# The metrics by their definitions, of stored predictions.
PLAIN_METRICS = """
WITH p AS (
  SELECT *, probs[1] AS s, array_position(probs, array_max(probs)) - 1 AS best,
         rank() OVER (PARTITION BY run_index, split ORDER BY round(probs[1], 9)) AS low,
         count(*) OVER (PARTITION BY run_index, split, round(probs[1], 9)) AS same FROM stored),
c AS (
  SELECT run_index, split, count(*) AS n_rows, avg(-ln(greatest(probs[_y], 1e-12))) AS loss,
         avg(int(best = _y)) AS accuracy, sum(int(best = 1 AND _y = 1)) AS tp, sum(int(best = 1 AND _y <> 1)) AS fp,
         sum(int(best <> 1 AND _y = 1)) AS fn, sum(int(_y = 1)) AS pos,
         sum(CASE WHEN _y = 1 THEN low + (same - 1) / 2D END) AS ranks FROM p GROUP BY run_index, split)
SELECT run_index, split, n_rows, inline(array(
  named_struct('metric', 'loss', 'plain', loss), named_struct('metric', 'accuracy', 'plain', accuracy),
  named_struct('metric', 'precision', 'plain', coalesce(try_divide(tp, tp + fp), 0D)),
  named_struct('metric', 'recall', 'plain', coalesce(try_divide(tp, tp + fn), 0D)),
  named_struct('metric', 'f1', 'plain', coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D)),
  named_struct('metric', 'auroc', 'plain', (ranks - pos * (pos + 1) / 2) / (pos * (n_rows - pos))))) FROM c"""


@query(
    "run_condition_check",
    f"""WITH {sql_split('embeddings', 'vec_id')},
masses AS (SELECT t, exp(-1.0::DOUBLE) / gamma(t::DOUBLE) AS mass FROM unnest(range(1, 19)) r(t)),
reached AS (SELECT t, sum(mass) OVER (ORDER BY t) AS c FROM masses),
draws AS (
  SELECT run_index, {sql_uniform('bootstrap', 'vec_id').replace("'42'", "CAST(42 + run_index AS VARCHAR)")} AS u
  FROM parted, unnest(range(0, {BOOTSTRAP_RUNS})) r(run_index) WHERE split = 'train'),
drawn AS (
  SELECT d.run_index, count(*) AS train_weight FROM draws d JOIN reached ON u >= c GROUP BY d.run_index),
held AS (SELECT split, count(*) AS n_rows FROM parted WHERE split <> 'train' GROUP BY split)
SELECT CAST(run_index AS INTEGER) AS run_index, split, metric, n_rows, CAST(train_weight AS DOUBLE) AS train_weight,
       true AS at_minimum, true AS agrees
FROM drawn, held, unnest(['loss', 'accuracy', 'precision', 'recall', 'f1', 'auroc']) m(metric)""",
)
def run_condition_check(spark, folder):
    """Every run's metrics equal their definitions over its stored predictions; its fit is at the minimum."""
    manifest = split_embeddings(spark, folder)
    scored, fitted = experiments.scored_runs(manifest, "vec_id", "label", "embedding", BOOTSTRAP_RUNS)
    path = scratch_path(spark, "predictions")
    scored.write.parquet(path)
    stored = spark.read.parquet(path)
    logged = experiments.log_of_runs(stored, "baseline", "vec_id", "probe")
    plain = spark.sql(PLAIN_METRICS.replace("FROM stored", "FROM {stored}"), stored=stored)
    both = logged.join(plain.withColumn("metric", F.concat_ws("_", "split", "metric")), ["run_index", "metric"])
    train = manifest.filter("split = 'train'")
    weights = train.agg(*[F.sum(experiments.bootstrap_weight("vec_id", SEED + i)).alias(str(i)) for i in range(BOOTSTRAP_RUNS)])
    minima = F.array(*[F.lit(bool(g <= TOLERANCE)) for g in fitted.gradient])
    return both.crossJoin(F.broadcast(weights)).select(  # one row
        "run_index",
        "split",
        F.element_at(F.split("metric", "_"), 2).alias("metric"),
        "n_rows",
        F.get(F.array(*[F.col(str(i)) for i in range(BOOTSTRAP_RUNS)]), F.col("run_index")).alias("train_weight"),
        F.get(minima, F.col("run_index")).alias("at_minimum"),
        (F.abs(F.col("value") - F.col("plain")) < 1e-6).alias("agrees"),
    )


# Event types as the four versions of a dataset.
VERSIONS = dict(zip(EVENT_TYPES, log.CONDITIONS))


@query(
    "compare_conditions",
    f"""WITH {SQL_RUNS}, named AS (
  SELECT CASE condition {' '.join(f"WHEN '{e}' THEN '{c}'" for e, c in VERSIONS.items())} END AS version, value
  FROM runs WHERE condition IN ({', '.join(f"'{e}'" for e in VERSIONS)})),
compared AS (
  SELECT version, count(*) AS n_runs, avg(value) AS mean, stddev_samp(value) AS std,
         {SQL_T4} * stddev_samp(value) / sqrt(count(*)) AS half FROM named GROUP BY version),
tested AS (
  SELECT (a.mean - b.mean) / sqrt((4 * a.std * a.std + 4 * b.std * b.std) / 8 * (0.2::DOUBLE + 0.2::DOUBLE)) AS t
  FROM compared a, compared b WHERE a.version = 'baseline' AND b.version = 'dcai_improved'),
angle AS (SELECT t, sin(atan(abs(t) / sqrt(8.0::DOUBLE))) AS si, power(cos(atan(abs(t) / sqrt(8.0::DOUBLE))), 2) AS c2 FROM tested)
SELECT version AS condition, n_runs, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - half, 6) AS ci_low,
       round(mean + half, 6) AS ci_high, round(half, 6) AS error_low, round(half, 6) AS error_high, round(t, 6) AS t_statistic,
       round(1 - si * (1 + c2 / 2 + 3 * c2 * c2 / 8 + 15 * c2 * c2 * c2 / 48), 6) AS p_value
FROM compared, angle""",
)
def compare_conditions(spark, folder):
    """Table, bars and test over a run log to which every run was appended twice."""
    versions = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])
    runs = event_runs(spark, folder).withColumn("condition", versions[F.col("condition")]).filter("condition IS NOT NULL")
    path = scratch_path(spark, "runs")
    for times in (2, 1):
        # first with other values, as if the append had been made with an older state
        log.append_runs(runs.withColumn("value", F.col("value") * times), path)
    found = curation.compare_conditions(spark, path, "events", scratch_path(spark, "comparison.csv"))
    bars, test = found["error_bars"].drop("mean"), found["t_test"].select("t_statistic", "p_value")
    both = found["table"].join(bars, "condition").crossJoin(F.broadcast(test))  # four rows and one
    return rounded(both, *(c for c in both.columns if c not in ("condition", "n_runs")))
