"""Long-form reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import severity_bucket


def _unpivot_pairs(df: DataFrame, keep: list, name: str, value: str, out_name: str, out_value: str) -> DataFrame:
    """Ten (name, value) column pairs to rows, identical rows once; one scan."""
    structs = [
        f"named_struct('{out_name}', {n}, '{out_value}', {v})" for n, v in schemas.ranked_pairs(name, value)
    ]
    pairs = F.expr(f"array({', '.join(structs)})")
    return df.select(*keep, F.inline(pairs)).distinct()


def top_issues_report(top_issues: DataFrame) -> DataFrame:
    """One row per ranked issue, with the date as text and as date."""
    keep = [
        "organization",
        "project",
        "model",
        F.col("processing_date").cast("string").alias("processing_date"),
        F.col("processing_date").alias("secondary_processing_date"),
        "input_data_amount",
    ]
    return _unpivot_pairs(top_issues, keep, "issue", "issue_importance", "issue", "importance_value")


def feature_importance_report(model_info: DataFrame) -> DataFrame:
    return _unpivot_pairs(model_info, ["model"], "feature", "feature_importance", "feature", "importance_value")


def _unpivot_metrics(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    named = df.selectExpr(*keep, *[f"{prefix}{m} AS {m.lower()}" for m in schemas.METRICS])
    return named.unpivot(keep, [m.lower() for m in schemas.METRICS], "metric", "measure").distinct()


def train_measures_report(model_info: DataFrame) -> DataFrame:
    return _unpivot_metrics(model_info, ["model"], "train_")


def performance_report(model_performance: DataFrame) -> DataFrame:
    return _unpivot_metrics(model_performance, ["model", "processing_date"], "")


def issues_report(issues: DataFrame) -> DataFrame:
    """Issues with a label for a missing severity and the ingestion date as text."""
    return issues.withColumns(
        {"severity": severity_bucket(F.col("severity")), "filter_ingested_at": F.col("ingested_at").cast("string")}
    )


def report_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def report_avg_importance(report: DataFrame, keys: list[str]) -> DataFrame:
    return report.groupBy(*keys).agg(F.avg("importance_value").alias("importance_value"), F.count("*").alias("count"))
