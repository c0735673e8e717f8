"""Metrics, statistics and the run log."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions.stats import t_critical, t_two_sided_p
from tamis.operators import experiments, metrics
from tamis.operators.splits import stratified_split
from tamis.plans import curation
from tamis.sources import runs as log


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_binary_metrics(spark):
    rows = [(1, 1)] * 8 + [(1, 0)] * 2 + [(0, 1)] * 4 + [(0, 0)] * 6
    found = metrics.binary_metrics(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert (found.accuracy, found.precision, found.recall) == pytest.approx((0.7, 8 / 12, 0.8))
    assert found.f1 == pytest.approx(16 / 22)
    none = metrics.binary_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0, 0.0)


def test_auroc_with_ties(spark):
    draw = np.random.default_rng(0)
    rows = [(int(draw.random() < 0.4), round(float(draw.random()), 1 if i % 2 else 6)) for i in range(500)]
    rows += [(1, 0.0), (0, 1.0)]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.auroc(scored(spark, rows), "label", "score").first().auroc == pytest.approx(want)


def test_auroc_by_group_and_undefined(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 1, 0.7), ("c", 1, 0.2), ("c", 0, 0.7)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    assert {r.g: r.auroc for r in metrics.auroc(df, "label", "score", ["g"]).collect()} == {"a": 1.0, "b": None, "c": 0.0}


def test_metric_suite_matches_its_parts(spark):
    draw = np.random.default_rng(9)
    rows = [(i, int(draw.random() < 0.5), (lambda p: [1 - p, p])(float(draw.random()))) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, label int, probs array<double>")
    suite = metrics.evaluate(df, "key", "label").first()
    pred = metrics.predictions(df, "key", "label", "probs")
    binary = metrics.binary_metrics(pred, "label", "prediction").first()
    assert [suite[c] for c in ("accuracy", "precision", "recall", "f1")] == pytest.approx(
        [binary[c] for c in ("accuracy", "precision", "recall", "f1")]
    )
    assert suite.auroc == pytest.approx(metrics.auroc(pred, "label", "positive_prob").first().auroc)
    assert suite.loss == pytest.approx(metrics.cross_entropy(df, "label", "probs").first().loss)
    assert suite.loss == pytest.approx(np.mean([-math.log(p[y]) for _, y, p in rows]))


def test_early_stop(spark):
    histories = {
        "plateau": [0.1, 0.5, 0.4, 0.5, 0.3, 0.9],
        "never": [0.0, 0.0, 0.0, 0.0],
        "rising": [0.1, 0.2, 0.3, 0.4],
    }
    rows = [(name, i, v) for name, values in histories.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, epoch int, f1 double")
    found = {r.run: tuple(r)[1:] for r in metrics.early_stop(df, "run", "epoch", "f1", patience=3).collect()}
    assert found == {"plateau": (1, 0.5, 4), "never": (0, 0.0, 2), "rising": (3, 0.4, None)}


# --- statistics --------------------------------------------------------------------


@pytest.mark.parametrize(
    "df, want", [(1, 12.706204736), (2, 4.302652730), (4, 2.776445105), (9, 2.262157163), (30, 2.042272456), (200, 1.971896224), (1_000_000, 1.959966361)]
)
def test_t_quantiles(spark, df, want):
    found = spark.range(1).select(t_critical(F.lit(float(df))).alias("t")).first().t
    assert found == pytest.approx(want, abs=1e-8)


def test_far_quantile_and_tail(spark):
    """One degree of freedom has a closed form: P(|T| > t) = 1 - 2 atan(t) / pi."""
    want = math.tan(math.pi / 2 * 0.9999)
    far, tail, zero, nan = spark.range(1).select(
        t_critical(F.lit(1.0), 0.9999), t_two_sided_p(F.lit(1e9), F.lit(1.0)), t_two_sided_p(F.lit(0.0), F.lit(4.0)), t_two_sided_p(F.lit(float("nan")), F.lit(4.0))
    ).first()
    assert far == pytest.approx(want, rel=1e-8)
    assert tail == pytest.approx(2 / math.pi * math.atan(1e-9), rel=1e-9)
    assert zero == 1.0 and math.isnan(nan)


def tail_by_integration(t, df):
    x = np.linspace(0, abs(t), 200_001)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * scale * np.trapezoid((1 + x * x / df) ** (-(df + 1) / 2), x)


def test_t_tail(spark):
    cases = [(2.0, 1), (2.0, 5), (-2.0, 8), (0.0, 3), (3.5, 41), (1.96, 998), (2.5, 1000), (2.5, 1001), (1.96, 5000)]
    df = spark.createDataFrame(cases, "t double, df int")
    for r in df.select("*", t_two_sided_p(F.col("t"), F.col("df").cast("double")).alias("p")).collect():
        assert r.p == pytest.approx(tail_by_integration(r.t, r.df), abs=1e-8)


def five_values(mean, std):
    """Five values with the given mean and sample deviation."""
    pattern = np.array([-2.0, -1.0, 0.0, 1.0, 2.0])
    return mean + pattern / pattern.std(ddof=1) * std


@pytest.fixture()
def published(spark):
    shape = {
        "baseline": (0.9974468085106384, 0.0023307342872560294),
        "noise_corrected": (0.9923113293326059, 0.0019193018464809814),
    }
    rows = [
        (i, 42 + i, "test_f1", float(v), "exp", c) for c, (m, s) in shape.items() for i, v in enumerate(five_values(m, s))
    ]
    rows += [(0, 42, "test_f1", 0.5, "exp", "cleaned"), (1, 43, "test_f1", float("nan"), "exp", "cleaned")]
    return spark.createDataFrame(rows, log.RUNS)


def test_published_comparison(published):
    rows = experiments.comparison_table(published).collect()
    assert [r.condition for r in rows] == ["baseline", "cleaned", "noise_corrected"]
    assert (rows[0].n_runs, rows[1].n_runs) == (5, 1)
    assert (rows[0].ci_low, rows[0].ci_high) == pytest.approx((0.9945528196567734, 1.0003407973645033), abs=1e-9)
    assert (rows[1].std, rows[1].ci_low, rows[1].ci_high) == (0.0, 0.5, 0.5)


def test_published_t_test(published):
    found = experiments.significance_test(published, "baseline", "noise_corrected").first()
    assert found.t_statistic == pytest.approx(3.80332, abs=1e-4)
    assert found.p_value == pytest.approx(0.005212, abs=1e-6)
    for other in ("cleaned", "dcai_improved"):
        with pytest.raises(Exception, match="two runs"):
            experiments.significance_test(published, "baseline", other).collect()


def test_run_log(spark, published, tmp_path):
    path = str(tmp_path / "runs")
    log.append_runs(published, path)
    log.append_runs(published.filter("condition = 'baseline'").withColumn("experiment", F.lit("other")), path)
    assert log.read_runs(spark, path, "exp", "baseline").count() == 5
    assert log.read_runs(spark, path, "exp").filter("value IS NULL").count() == 1
    plan = log.read_runs(spark, path, "exp", "baseline")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan
    with pytest.raises(ValueError):
        log.read_runs(spark, path, "unknown")
    with pytest.raises(ValueError):
        log.append_runs(published.withColumn("condition", F.lit("odd")), path)
    result = curation.compare_conditions(spark, path, "exp", str(tmp_path / "table.csv"))
    assert "t_test" not in result and result["error_bars"].count() == 3


def test_metrics_wide_and_long(spark):
    wide = spark.createDataFrame([("e", "c", 0, 0.5, 0.25)], "experiment string, condition string, run_index int, f1 double, loss double")
    long = log.metrics_to_long(wide, ["experiment", "condition", "run_index"], "val_")
    assert {(r.metric, r.value) for r in long.collect()} == {("val_f1", 0.5), ("val_loss", 0.25)}
    back = log.metrics_to_wide(long, ["val_f1", "val_loss"]).first()
    assert (back.val_f1, back.val_loss) == (0.5, 0.25)


def test_learning_curve(spark):
    a = spark.createDataFrame([(10, 0.5), (20, 0.8)], "n_labeled int, val_f1 double")
    b = spark.createDataFrame([(10, 0.4), (30, 0.9)], "n_labeled int, val_f1 double")
    rows = {r.n_labeled: r.gain for r in experiments.learning_curve(a, b).collect()}
    assert rows == {10: pytest.approx(0.1), 20: None, 30: None}


def test_conditions_end_to_end(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in draw.normal(i % 2, 0.8, 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, label int, vec array<float>")
    manifest = stratified_split(df, "key", "label").cache()
    path = str(tmp_path / "runs")
    improved = curation.improved_condition(manifest, "key", "label", "vec")
    assert improved.filter("key LIKE 'aug_%'").count() > 0
    for condition, rows in (("baseline", manifest), ("dcai_improved", improved)):
        summary = curation.log_condition(rows, condition, "key", "label", "vec", "exp", path, n_runs=2).first()
        assert summary.n_runs == 2 and summary["mean"] > 0.7
    stored = log.read_runs(spark, path, "exp", "baseline")
    assert stored.count() == 2 * 2 * 6
    result = curation.compare_conditions(spark, path, "exp", str(tmp_path / "table.csv"))
    assert result["t_test"].first().condition_b == "dcai_improved"
    with pytest.raises(ValueError):
        experiments.run_condition(manifest, "odd", "key", "label", "vec", "exp")


def test_runs_are_replaced_when_appended_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda condition, run, metric, value: ("e", condition, run, 42 + run, metric, value)
    shape = "experiment string, condition string, run_index int, run_seed bigint, metric string, value double"
    first = [row("baseline", i, m, float(i)) for i in range(3) for m in ("val_f1", "test_f1")]
    log.append_runs(spark.createDataFrame(first, shape), path)
    log.append_runs(spark.createDataFrame(first, shape), path)
    assert log.read_runs(spark, path, "e").count() == 6
    # a run with fewer metrics takes the place of the whole run; the others stay
    log.append_runs(spark.createDataFrame([row("baseline", 1, "test_f1", 9.0), row("cleaned", 1, "test_f1", float("nan"))], shape), path)
    got = sorted((r.condition, r.run_index, r.metric, r.value) for r in log.read_runs(spark, path, "e").collect())
    assert got == [("baseline", 0, "test_f1", 0.0), ("baseline", 0, "val_f1", 0.0), ("baseline", 1, "test_f1", 9.0), ("baseline", 2, "test_f1", 2.0), ("baseline", 2, "val_f1", 2.0), ("cleaned", 1, "test_f1", None)]
