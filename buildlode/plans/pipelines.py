"""The three feature pipelines and the step that fits or reloads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame

from .. import schemas
from ..operators import features as X
from ..sources.sinks import Artefacts, pipeline_name


@dataclass
class FittedFeatures:
    """A fitted pipeline, the names of its vector slots and the columns it left out."""

    model: PipelineModel
    names: list[str]
    dropped: list[str]


def quality_pipeline(numerics: list[str]) -> Pipeline:
    """Impute, index, one-hot, scale, label; category slots come first."""
    categories = schemas.MEASURE_CATEGORIES
    return Pipeline(
        stages=[
            X.imputer(numerics),
            *[X.category_indexer(c) for c in categories],
            X.one_hot(categories),
            X.numeric_assembler(numerics),
            X.scaler(),
            X.label_indexer(),
            VectorAssembler(
                inputCols=[f"{c}_class_vec" for c in categories] + ["scaled_numerics"],
                outputCol="features",
                handleInvalid="skip",
            ),
        ]
    )


def issue_flow_pipeline(numerics: list[str] = schemas.FLOW_FEATURES) -> Pipeline:
    """Scale the flow counts, label."""
    return Pipeline(
        stages=[X.numeric_assembler(numerics), X.scaler("numeric_vec", "features"), X.label_indexer()]
    )


def rule_pipeline() -> Pipeline:
    """Rule vocabulary: most frequent first, ties by name; unknown rules are skipped."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="rule", outputCol="slot", handleInvalid="skip", stringOrderType="frequencyDesc")
        ]
    )


def vocabulary(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def fit_or_load(df: DataFrame, study: int, mode: str, artefacts: Artefacts) -> PipelineModel:
    """Fit and save in a first run, load in an incremental one."""
    if mode == "incremental":
        return artefacts.load(pipeline_name(study), PipelineModel)
    if study == 1:
        # A column without any value has no mean to impute, so it is left out.
        empty = set(X.all_null_columns(df, schemas.QUALITY_NUMERICS))
        pipeline = quality_pipeline([c for c in schemas.QUALITY_NUMERICS if c not in empty])
    else:
        pipeline = issue_flow_pipeline() if study == 2 else rule_pipeline()
    model = pipeline.fit(df)
    artefacts.save(pipeline_name(study), model)
    return model


def quality_features(df: DataFrame, mode: str, artefacts: Artefacts) -> FittedFeatures:
    model = fit_or_load(df, 1, mode, artefacts)
    numerics = model.stages[0].getInputCols()
    encoder = model.stages[1 + len(schemas.MEASURE_CATEGORIES)]
    names = X.category_names(schemas.MEASURE_CATEGORIES, encoder.categorySizes) + list(numerics)
    return FittedFeatures(model, names, [c for c in schemas.QUALITY_NUMERICS if c not in set(numerics)])


def issue_flow_features(df: DataFrame, mode: str, artefacts: Artefacts) -> FittedFeatures:
    return FittedFeatures(fit_or_load(df, 2, mode, artefacts), list(schemas.FLOW_FEATURES), [])
