"""Feature steps on ``pyspark.ml`` stages, unpacked to plain columns where useful."""

from __future__ import annotations

from pyspark.ml.feature import (
    Imputer,
    MinMaxScaler,
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FAIL, SUCCESS


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a single value, found in one pass."""
    counts = df.agg(*[F.expr(f"count(`{c}`) AS `{c}`") for c in columns]).first()
    return [c for c in columns if counts[c] == 0]


def imputer(columns: list[str]) -> Imputer:
    return Imputer(inputCols=columns, outputCols=columns, strategy="mean")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become the column mean. All-NULL columns are left as they are."""
    empty = set(all_null_columns(df, columns))
    return imputer([c for c in columns if c not in empty]).fit(df).transform(df)


def category_indexer(column: str) -> StringIndexer:
    """Most frequent value is 0, ties by name; NULL and unseen get an extra index."""
    return StringIndexer(
        inputCol=column, outputCol=f"{column}_index", handleInvalid="keep", stringOrderType="frequencyDesc"
    )


def one_hot(columns: list[str]) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns],
        outputCols=[f"{c}_class_vec" for c in columns],
        handleInvalid="error",
        dropLast=False,
    )


def numeric_assembler(columns: list[str], output: str = "numeric_vec") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")


def scaler(source: str = "numeric_vec", output: str = "scaled_numerics") -> MinMaxScaler:
    return MinMaxScaler(inputCol=source, outputCol=output)


def label_indexer() -> StringIndexerModel:
    """SUCCESS is 0.0 and FAIL is 1.0, whichever is more frequent; two classes only."""
    return StringIndexerModel.from_labels(
        [SUCCESS, FAIL], inputCol="result", outputCol="label", handleInvalid="skip"
    )


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0.5."""
    prepared = numeric_assembler(columns).transform(df)
    scaled = scaler().fit(prepared).transform(prepared)
    return spread(scaled.drop(*columns, "numeric_vec"), "scaled_numerics", columns)


def spread(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Vector slots as plain double columns."""
    slots = vector_to_array(F.col(vector))
    rest = [c for c in df.columns if c != vector]
    return df.withColumn("__slots", slots).selectExpr(
        *rest, *[f"__slots[{i}] AS `{n}`" for i, n in enumerate(names)]
    )


def category_names(columns: list[str], sizes: list[int]) -> list[str]:
    """``alert_status_index_0`` ... for every one-hot slot."""
    return [f"{c}_index_{i}" for c, size in zip(columns, sizes) for i in range(size)]
