"""Result tables and saved model artefacts."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .files import exists


class ParquetResults:
    """Result tables as Parquet folders, one partition per processing date."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, df: DataFrame) -> None:
        dated(df, table).write.mode("append").partitionBy("processing_date").parquet(f"{self.root}/{table}")

    def table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")


class JdbcResults:
    """Result tables in a relational database."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]):
        self.spark, self.url, self.properties = spark, url, properties

    def append(self, table: str, df: DataFrame) -> None:
        dated(df, table).write.jdbc(self.url, table, mode="append", properties=self.properties)


def dated(df: DataFrame, table: str) -> DataFrame:
    """Declared columns of a result table plus the processing date."""
    columns = schemas.TABLES[table].names
    return df.select(*columns).withColumn("processing_date", F.current_date())


def result_rows(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Typed rows from driver-side metrics; a missing cell is NULL."""
    schema = schemas.TABLES[table]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


# Artefact names by model number; saved studies are found by them.
STUDIES = (1, 2, 3)
SUFFIXES = ("", "_top_10")
CLASSIFIERS = ("LogisticRegressionModel", "DecisionTreeModel", "RandomForestModel")
LABEL_INDEXER = "label_indexer_3"


def pipeline_name(study: int) -> str:
    return f"pipeline_{study}"


def selector_name(study: int) -> str:
    return f"ChiSquareSelectorModel_{study}"


def classifier_name(kind: str, study: int, top10: bool = False) -> str:
    return f"{kind}_{study}{SUFFIXES[top10]}"


def expected_artefacts() -> list[str]:
    models = [f"{kind}_{i}{s}" for i in STUDIES for s in SUFFIXES for kind in CLASSIFIERS]
    return models + [f(i) for i in STUDIES for f in (pipeline_name, selector_name)] + [LABEL_INDEXER]


class Artefacts:
    """Saved pipelines, selectors and models below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, stage: MLWritable) -> None:
        stage.write().overwrite().save(self.path(name))

    def load(self, name: str, kind):
        return kind.load(self.path(name))

    def missing(self) -> list[str]:
        return [n for n in expected_artefacts() if not exists(self.spark, self.path(n))]

    def usable_mode(self, mode: str) -> str:
        """``incremental`` needs every artefact; otherwise the run is a ``first`` one."""
        return "first" if mode == "incremental" and self.missing() else mode
