"""Scans of stored tables: Parquet folders or a JDBC database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.filters import filter_processed, filter_scope
from .store import LAYOUT


class ParquetTables:
    """Tables stored as one Parquet folder each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop(*LAYOUT)


class JdbcTables:
    """Tables of a relational database.

    With ``partition`` = (column, lower, upper, parts) a table is read by that many
    tasks; without it one connection reads all. Filters and columns chosen later are
    pushed into the database by Spark.
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str], partition: dict[str, tuple] | None = None):
        self.spark, self.url, self.properties, self.partition = spark, url, properties, partition or {}

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.properties)
        if name in self.partition:
            column, lower, upper, parts = self.partition[name]
            reader = reader.options(
                partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts
            )
        return reader.load()


def scan_columns(df: DataFrame, table: str, all_columns: bool = False) -> DataFrame:
    """Declared columns of a table, without scope column and bookkeeping; or all."""
    if all_columns:
        return df
    scope = schemas.SCOPE_COLUMN.get(table)
    return df.select(*[c for c in schemas.TABLES[table].names if c != scope and c in df.columns])


def scan_table(
    tables,
    table: str,
    processed: bool | None = None,
    scope=None,
    where: list[Column | str] = (),
    all_columns: bool = False,
) -> DataFrame:
    """Read a table: scope and flag filters, further conditions, then columns.

    ``tables`` is anything with ``table(name)``. Everything here is declarative, so
    filters and columns reach the Parquet scan or the database query.
    """
    df = tables.table(table)
    if scope is not None:
        df = filter_scope(df, schemas.SCOPE_COLUMN[table], scope)
    df = filter_processed(df, processed)
    for condition in where:
        df = df.where(condition)
    return scan_columns(df, table, all_columns)


def batch_registry(source: DataFrame) -> DataFrame:
    """(batch_number, org_keys, servers) for every batch 0..max; empty batches too.

    Each batch has its own sources only. The registry is the hand-kept list of
    mined sources, so its per-batch sets stay small.
    """
    numbers = source.agg(F.max("batch_number").alias("last")).where(F.col("last").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("batch_number")
    )
    sets = source.groupBy("batch_number").agg(
        F.sort_array(F.collect_set("sonar_org_key")).alias("org_keys"),
        F.sort_array(F.collect_set("jenkins_server")).alias("servers"),
    )
    empty = F.array().cast("array<string>")
    return numbers.join(sets, "batch_number", "left").select(
        "batch_number",
        F.coalesce("org_keys", empty).alias("org_keys"),
        F.coalesce("servers", empty).alias("servers"),
    )


def max_batch(source: DataFrame) -> DataFrame:
    return source.agg(F.max("batch_number").alias("max_batch"))


def distinct_sources(source: DataFrame, column: str) -> DataFrame:
    return source.select(column).distinct()


def project_pairs(analyses: DataFrame) -> DataFrame:
    return analyses.select("organization", "project").distinct()


def sql_view(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Run stored SQL over DataFrames named in the text as ``{name}``; no global views."""
    return spark.sql(text, **views)
