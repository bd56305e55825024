"""Feature selection, training and evaluation of build-outcome classifiers."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import rounded
from ..operators import chi2
from ..operators.balance import minority_weight, train_flag
from ..operators.metrics import full_report, score_table
from ..session import cut_lineage
from ..sources.sinks import CLASSIFIERS, Artefacts, classifier_name, result_rows, selector_name

SEED = 42
# Sizes of the three classifiers.
LR_ITERATIONS, TREE_DEPTH, FOREST_TREES = 10, 5, 100
# Scaled features, from 0 to 1, are cut into so many equal steps for the chi-square test.
STEPS = 10
LOADERS = dict(
    zip(CLASSIFIERS, [LogisticRegressionModel, DecisionTreeClassificationModel, RandomForestClassificationModel])
)


def classifiers() -> dict:
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return dict(
        zip(
            CLASSIFIERS,
            [
                LogisticRegression(maxIter=LR_ITERATIONS, **common),
                DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **common),
                RandomForestClassifier(numTrees=FOREST_TREES, seed=SEED, **common),
            ],
        )
    )


# ----------------------------------------------------------------- selection


def dense_tests(samples: DataFrame) -> DataFrame:
    """Chi-square of every slot of a dense vector, its values cut into equal steps.

    Continuous values would make one category each. The cuts are fixed, so the test
    does not hang on the order in which rows are read, and serve the test only.
    """
    slots = samples.select("label", F.posexplode(vector_to_array("features")).alias("feature", "raw"))
    # Nine digits: float noise of the scaling must not move a value over a cut.
    step = F.least(F.floor(F.expr(rounded("raw", 9)) * STEPS), F.lit(STEPS - 1)).cast("int")
    binned = slots.select("feature", step.alias("value"), "label")
    cells = binned.groupBy("feature", "value").agg(*chi2.outcome_counts())
    return chi2.chi_square(cells, samples.agg(*chi2.outcome_counts()), [])


def count_tests(cells: DataFrame, outcomes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Chi-square of sparse counts: (keys, analysis_key, slot, n) against builds.

    Builds are counted per analysis first, as all builds of an analysis share its
    counts, so the join is analyses by features, not builds by features.
    """
    # Read by the totals and by the cells.
    per_analysis = cut_lineage(outcomes.groupBy(*keys, "analysis_key").agg(*chi2.outcome_counts()), "outcome-counts")
    valued = cells.join(per_analysis, [*keys, "analysis_key"]).groupBy(
        *keys, F.col("slot").alias("feature"), F.col("n").alias("value")
    ).agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    totals = per_analysis.groupBy(*keys).agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    return chi2.chi_square(valued, totals, list(keys))


def chi2_select(tests: DataFrame, names: list[str], rows: int, study: int, artefacts: Artefacts):
    """Fit and save the selector of the ten most telling slots.

    Returns the selector, the chosen names and the row for ``model_info``.
    """
    best = chi2.top10_chi2(tests, []).orderBy("rank").collect()
    selector = VectorSlicer(inputCol="features", outputCol="selected", indices=[r["feature"] for r in best])
    artefacts.save(selector_name(study), selector)
    info = {"model": selector_name(study), "train_data_amount": rows}
    for (name, value), r in zip(schemas.ranked_pairs("feature", "feature_importance"), best):
        info[name], info[value] = names[r["feature"]], float(r["statistic"])
    return selector, [names[r["feature"]] for r in best], info


def load_selector(study: int, names: list[str], artefacts: Artefacts):
    selector = artefacts.load(selector_name(study), VectorSlicer)
    return selector, [names[i] for i in selector.getIndices()]


def selected(samples: DataFrame, selector: VectorSlicer) -> DataFrame:
    return selector.transform(samples).drop("features").withColumnRenamed("selected", "features")


# ---------------------------------------------------------------- evaluation


def score_all(models: dict, samples: DataFrame) -> DataFrame:
    """One row per (model, sample) with prediction and score; samples are read once."""
    scored, parts = samples, []
    for i, (name, model) in enumerate(models.items()):
        columns = {"prediction": f"prediction_{i}", "probability": f"probability_{i}", "raw": f"raw_{i}"}
        model = model.copy()
        model.setPredictionCol(columns["prediction"]).setProbabilityCol(columns["probability"])
        model.setRawPredictionCol(columns["raw"])
        scored = model.transform(scored)
        parts.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col(columns["prediction"]).alias("prediction"),
                vector_to_array(columns["probability"])[1].alias("score"),
            )
        )
    keep = [c for c in ("row_key", "is_train", "weight", "label") if c in samples.columns]
    return scored.select(*keep, F.inline(F.array(*parts)))


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics per key from one pass over the scored rows.

    The table in between has a row per distinct score; it is written once so that no
    metric scores the samples again.
    """
    weight = F.col("weight") if "weight" in scored.columns else None
    return full_report(cut_lineage(score_table(scored, keys, weight), "scores"), keys)


def performance_rows(report: DataFrame) -> DataFrame:
    return report.select("model", F.col("n").cast("int").alias("data_amount"), *schemas.METRICS)


def importance_cells(model, names: list[str]) -> dict:
    """Largest importances of a tree model as (feature_i, feature_importance_i) cells."""
    if not hasattr(model, "featureImportances"):
        return {}
    vector = model.featureImportances
    ranked = sorted(zip(vector.values.tolist(), vector.indices.tolist()), key=lambda x: (-x[0], x[1]))
    cells = {}
    for (name, value), (importance, slot) in zip(schemas.ranked_pairs("feature", "feature_importance"), ranked):
        cells[name], cells[value] = names[slot], importance
    return cells


# ------------------------------------------------------------------ training


def train(samples: DataFrame, names: list[str], study: int, artefacts: Artefacts, top10: bool = False):
    """Fit, save and evaluate the three classifiers.

    ``samples``: (row_key, label, features), already written out. The split hangs on
    the row key. Failed training rows weigh eleven times instead of being copied, so
    the training data does not grow. Returns rows for ``model_performance`` (test)
    and ``model_info`` (train).
    """
    is_train = train_flag(["row_key"])
    split = samples.withColumns(
        {"is_train": is_train, "weight": F.when(is_train, minority_weight()).otherwise(F.lit(1)).cast("double")}
    )
    training = split.where("is_train")
    models = {}
    for kind, estimator in classifiers().items():
        models[classifier_name(kind, study, top10)] = model = estimator.fit(training)
        artefacts.save(classifier_name(kind, study, top10), model)

    report = cut_lineage(evaluate(score_all(models, split), ["model", "is_train"]), "report")
    performance = performance_rows(report.where(~F.col("is_train")))
    # Three rows: metrics of each model meet its importances on the driver.
    rows = []
    for r in report.where("is_train").collect():
        cells = {f"train_{m}": r[m] for m in schemas.METRICS}
        rows.append({"model": r["model"], "train_data_amount": r["n"], **cells, **importance_cells(models[r["model"]], names)})
    return performance, result_rows(samples.sparkSession, "model_info", rows)


def score_incremental(samples: DataFrame, study: int, artefacts: Artefacts, top10: bool = False) -> DataFrame:
    """Metrics of the saved classifiers on new rows, as ``model_performance`` rows."""
    return performance_rows(evaluate(score_all(saved_models(study, artefacts, top10), samples), ["model"]))


def saved_models(study: int, artefacts: Artefacts, top10: bool = False) -> dict:
    return {
        classifier_name(kind, study, top10): artefacts.load(classifier_name(kind, study, top10), loader)
        for kind, loader in LOADERS.items()
    }


def score_rows(samples: DataFrame, study: int, artefacts: Artefacts) -> DataFrame:
    """(row_key, label, model, prediction, score) of all saved classifiers of a study, those
    on all features and those on the ten best."""
    selector = artefacts.load(selector_name(study), VectorSlicer)
    every = score_all(saved_models(study, artefacts), samples)
    return every.unionByName(score_all(saved_models(study, artefacts, True), selected(samples, selector)))
