"""Row filters and column selections; every one is pushed into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import is_small

# In-list scopes above this many values become a semi join instead.
IN_LIST_LIMIT = 1_000


def filter_scope(df: DataFrame, column: str, values) -> DataFrame:
    """Rows of the given organizations or servers.

    ``values`` is a list, or a one-column DataFrame of any size. A DataFrame
    joins as a semi join: broadcast after its size was counted, shuffled otherwise.
    """
    if not isinstance(values, DataFrame):
        values = list(values)
        if len(values) <= IN_LIST_LIMIT:
            return df.where(F.col(column).isin(values))
        values = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    keys = values.toDF(column).distinct()
    return df.join(F.broadcast(keys) if is_small(keys) else keys, column, "left_semi")


def filter_processed(df: DataFrame, processed: bool | None) -> DataFrame:
    """Seen (True) or new (False) rows; a NULL flag is in neither. None keeps all."""
    if processed is None:
        return df
    return df.where(F.col("processed") if processed else ~F.col("processed"))


def filter_keys(df: DataFrame, table: str) -> DataFrame:
    """Rows that carry the key the models need."""
    key = schemas.KEY_COLUMN.get(table)
    return df.where(F.col(key).isNotNull()) if key else df


def open_issues(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("status").isin(schemas.OPEN_STATUSES))


def closed_issues(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("status").isin(schemas.CLOSED_STATUSES))


def of_project(df: DataFrame, organization: str, project: str) -> DataFrame:
    """One project, named by organization and project: names repeat across organizations."""
    return df.where((F.col("organization") == organization) & (F.col("project") == project))


def drop_bookkeeping(df: DataFrame, scope: str | None = None) -> DataFrame:
    return df.drop(*schemas.BOOKKEEPING, *([scope] if scope else []))


def drop_sparse_measures(measures: DataFrame) -> DataFrame:
    return measures.drop(*schemas.SPARSE_MEASURES)


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), one pass over the data."""
    shares = df.agg(*[F.expr(f"avg(cast(`{c}` IS NULL AS double)) AS `{c}`") for c in columns])
    return shares.unpivot([], columns, "column", "null_share")


def drop_sparse_columns(df: DataFrame, columns: list[str], max_null_share: float) -> DataFrame:
    """Drop the columns whose share of NULLs is above the threshold."""
    too_sparse = null_shares(df, columns).where(F.col("null_share") > max_null_share)
    return df.drop(*[row["column"] for row in too_sparse.collect()])


def cast_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """One projection for all columns, not a chain of single-column steps."""
    wanted = set(columns)
    return df.selectExpr(*[f"cast(`{c}` AS double) AS `{c}`" if c in wanted else f"`{c}`" for c in df.columns])
