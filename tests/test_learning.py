"""Features, chi-square, metrics, trees and the jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from buildlode import schemas
from buildlode.catalog.studies import study
from buildlode.domain import Domain
from buildlode.operators import balance, chi2, features, metrics, trees
from buildlode.plans import jobs, training
from buildlode.session import cut_lineage


@pytest.fixture(scope="module")
def samples(spark):
    """300 rows, three count features of which one follows the label."""
    rng = np.random.default_rng(7)
    label = rng.integers(0, 2, 300)
    rows = [(i, float(y), int(rng.integers(0, 4)), int(y * 2 + rng.integers(0, 2)), int(rng.integers(0, 2))) for i, y in enumerate(label)]
    return spark.createDataFrame(rows, "analysis_key int, label double, x0 int, x1 int, x2 int").cache()


NAMES = ["x0", "x1", "x2"]


def assembled(df):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def cells_of(df, keys=()):
    long = df.unpivot(["analysis_key", *keys], NAMES, "name", "n").where("n > 0")
    return long.select(*keys, "analysis_key", F.substring("name", 2, 1).cast("int").alias("slot"), F.col("n").cast("long").alias("n"))


def test_chi_square_and_p_values_equal_spark_ml(samples):
    want = {r.featureIndex: r for r in ChiSquareTest.test(assembled(samples), "features", "label", True).collect()}
    for tests in (training.count_tests(cells_of(samples), samples), chi2.chi_square(
        chi2.value_cells(samples, NAMES).withColumn("feature", F.substring("feature", 2, 1).cast("int")),
        samples.agg(*chi2.outcome_counts()), [],
    )):
        got = {r.feature: r for r in chi2.with_p_value(tests).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            assert r.dof == want[i].degreesOfFreedom
            assert r.statistic == pytest.approx(want[i].statistic, rel=1e-9)
            assert r.p_value == pytest.approx(want[i].pValue, rel=1e-6, abs=1e-12)


def test_chi_square_with_one_outcome_or_one_value(spark, samples):
    one = samples.withColumn("label", F.lit(1.0)).withColumn("x0", F.lit(1))
    assert {(r.statistic, r.dof) for r in training.count_tests(cells_of(one), one).collect()} == {(0.0, 0)}


def test_top10_is_padded(samples):
    best = chi2.top10_chi2(training.count_tests(cells_of(samples), samples), [])
    wide = chi2.widen_ranked(best.withColumn("all", F.lit(1)), ["all"], "feature", "statistic", "f", "v").first()
    assert wide.f_1 == 1 and wide.f_3 is not None and wide.f_4 is None and wide.v_10 is None


def test_label_is_fail_even_in_majority_or_tie(spark):
    df = spark.createDataFrame([("FAIL",), ("FAIL",), ("SUCCESS",)], "result string")
    assert [r.label for r in features.label_indexer().transform(df).collect()] == [1.0, 1.0, 0.0]


def test_all_null_feature_does_not_stop_imputing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert features.all_null_columns(df, ["a", "b"]) == ["b"]
    assert [tuple(r) for r in features.impute_mean(df, ["a", "b"]).collect()] == [(1.0, None), (1.0, None)]


def test_split_is_stable_and_weights_match_copies(samples):
    train, test = balance.split_train_test(samples, ["analysis_key"])
    again, _ = balance.split_train_test(samples.repartition(3), ["analysis_key"])
    assert train.count() + test.count() == 300 and train.exceptAll(again).isEmpty()
    assert 0.6 < train.count() / 300 < 0.8
    copies = balance.oversample_minority(train).groupBy("label").count().collect()
    weights = balance.weigh_minority(train).groupBy("label").agg(F.sum("weight").alias("count")).collect()
    assert {(r.label, float(r["count"])) for r in copies} == {(r.label, r["count"]) for r in weights}


def test_metrics_equal_spark_evaluators(spark):
    df = spark.range(3000).select(
        ((F.col("id") * 7919) % 10 < 3).cast("double").alias("label"),
        ((F.col("id") * 104729) % 10 < 4).cast("double").alias("prediction"),
        (((F.col("id") * 31) % 997) / 1000.0).alias("score"),
        F.lit("m").alias("model"),
    )
    got = metrics.full_report(cut_lineage(metrics.score_table(df, ["model"]), "scores"), ["model"]).first()
    multi = MulticlassClassificationEvaluator()
    for name, ours in (("f1", "f1"), ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"), ("accuracy", "accuracy")):
        assert got[ours] == pytest.approx(multi.evaluate(df, {multi.metricName: name}), rel=1e-9)
    area = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert got.area_under_ROC == pytest.approx(area.evaluate(df, {area.metricName: "areaUnderROC"}), rel=1e-6)
    assert got.area_under_PR == pytest.approx(area.evaluate(df, {area.metricName: "areaUnderPR"}), rel=1e-6)


def test_areas_of_crowded_scores(spark):
    # Two classes apart by less than any rounding of scores would keep, all near 1.
    df = spark.range(4000).select(
        (F.col("id") % 4 == 0).cast("double").alias("label"),
        F.lit(1.0).alias("prediction"),
        (1 - F.when(F.col("id") % 4 == 0, F.col("id") % 97).otherwise(50 + F.col("id") % 89) * 1e-12).alias("score"),
        F.lit("m").alias("model"),
    )
    got = metrics.full_report(cut_lineage(metrics.score_table(df, ["model"]), "scores"), ["model"]).first()
    area = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert 0.6 < got.area_under_ROC < 1
    assert got.area_under_ROC == pytest.approx(area.evaluate(df, {area.metricName: "areaUnderROC"}), rel=1e-9)
    assert got.area_under_PR == pytest.approx(area.evaluate(df, {area.metricName: "areaUnderPR"}), rel=1e-9)


def exact_tail(statistic, dof):
    """The same tail in 60 digits: the finite sum, and 1 - P for one degree of freedom."""
    from decimal import Decimal, localcontext

    with localcontext() as c:
        c.prec = 60
        x, pi = Decimal(statistic) / 2, Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        odd, total, n = dof % 2, Decimal(0), 0
        if odd:
            term = low = 2 * (-x).exp() * (x / pi).sqrt()
            while term > low * Decimal(10) ** -58:
                n += 1
                term *= x / (n + Decimal("0.5"))
                low += term
            total = 1 - low
        exponent = Decimal(odd) / 2
        term = (-x).exp() * (2 * (x / pi).sqrt() if odd else 1)
        for i in range((dof - odd) // 2):
            if i:
                term *= x / (i + exponent)
            total += term
        return float(total)


def test_p_values_against_sixty_digits(spark):
    from buildlode.functions.stats import chi2_p_value

    cases = [(s, k) for s in (1e-9, 0.02, 0.7, 2.9, 3.1, 9.5, 42.0, 88.0) for k in (1, 2, 3, 4, 9, 30, 77)]
    cases += [(900.0, 1000), (1500.0, 1501), (2000.0, 1200), (0.0, 3), (5.0, 0), (4000.0, 2), (None, 3)]
    df = spark.createDataFrame(cases, "statistic double, dof int").withColumn("p", chi2_p_value("statistic", "dof"))
    for r in df.collect():
        want = 1.0 if not r.statistic or not r.dof else exact_tail(r.statistic, r.dof)
        assert r.p == pytest.approx(want, rel=1e-10, abs=1e-300), r
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()

def test_no_failed_rows_means_no_rate(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "label double, prediction double")
    assert metrics.multiclass_metrics(metrics.confusion_counts(df)).first().predicted_negative_rate is None


def test_grouped_trees_equal_spark_ml(spark, samples):
    # Two groups grown together; each must equal a tree fitted on the group alone.
    both = samples.withColumn("project", F.when(F.col("analysis_key") % 3 == 0, F.lit("small")).otherwise(F.lit("large")))
    splits = trees.grow(trees.single_tree_weights(both, ["project"]), cells_of(both, ["project"]), ["project"], 3)
    got = {(r.project, r.slot): r.importance for r in trees.importances(splits, ["project"]).collect()}
    for project in ("small", "large"):
        model = DecisionTreeClassifier(maxDepth=3).fit(assembled(both.where(F.col("project") == project)))
        for slot, value in enumerate(model.featureImportances.toArray()):
            assert got.get((project, slot), 0.0) == pytest.approx(value, abs=1e-9)


def test_forest_repeats_and_sums_to_one(spark, samples):
    one = samples.withColumns({"project": F.lit("p"), "row_key": F.col("analysis_key").cast("string")})
    subsets = trees.feature_subsets(spark, 3, 5, 3, 1)
    assert subsets.groupBy("tree", "node").count().select("count").distinct().collect()[0][0] == 2
    run = lambda df: {r.slot: r.importance for r in trees.importances(trees.grow(
        trees.bootstrap_weights(df, ["project"], 5, "row_key", 1), cells_of(df, ["project"]), ["project"], 3, subsets), ["project"]).collect()}
    first, second = run(one), run(one.repartition(5))
    assert sum(first.values()) == pytest.approx(1.0) and max(first, key=first.get) == 1
    assert first == pytest.approx(second)


def test_first_then_incremental_run(spark):
    s = study(Domain(spark, "/root/testdata/sf0.001"))
    first = jobs.run_all(s, "incremental")
    assert s.artefacts.missing() == []
    second = jobs.run_all(s, "incremental")
    for reports in (first, second):
        for number, name in enumerate(("ml1", "ml2", "ml3"), 1):
            rows = reports[name].collect()
            assert len(rows) == 6 and all(r.model.endswith((f"_{number}", f"_{number}_top_10")) for r in rows)
            assert all(0.0 <= r[m] <= 1.0 for r in rows for m in schemas.METRICS if r[m] is not None)
    info = s.results.table("model_info")
    assert info.count() == 3 * (1 + 6)
    impact = jobs.issue_impact_by_project(s)
    assert impact.columns == schemas.TOP_ISSUES.names
    assert {r.model for r in impact.select("model").distinct().collect()} == {"ChiSquareSelectorModel", "DecisionTreeModel", "RandomForestModel"}
    assert impact.where("issue_2 is null and model <> 'ChiSquareSelectorModel'").count() == 0
    # Delta rows of the quality study: every joined row with anything new, once.
    assert second["ml1"].first().data_amount == jobs.quality_rows(s, "incremental").count()
