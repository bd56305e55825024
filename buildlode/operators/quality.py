"""Joins between builds, analyses, measures and issue flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import binary_result
from ..session import is_small
from .issues import with_totals


def measures_x_analyses(measures: DataFrame, analyses: DataFrame, on: list[str] = ()) -> DataFrame:
    """Measure features with the revision their analysis looked at.

    ``on`` names further join keys both sides carry, such as a batch number.
    """
    features = schemas.MEASURE_NUMERICS + schemas.MEASURE_CATEGORIES
    return measures.select(*on, "analysis_key", *features).join(
        analyses.select(*on, "analysis_key", "revision"), [*on, "analysis_key"]
    ).select(*on, "revision", *features)


def _with_analysis(builds: DataFrame, analyses: DataFrame, on: list[str], keep: list[str] = ()) -> DataFrame:
    """Builds with the analyses of their revision: both sides are narrow, so this join
    goes first and the wide feature table is shuffled only once, by analysis key."""
    keys = analyses.select(*on, "analysis_key", F.col("revision").alias("revision_number"), *keep)
    return builds.join(keys, [*on, "revision_number"])


def builds_x_measures(builds: DataFrame, measures: DataFrame, analyses: DataFrame, on: list[str] = ()) -> DataFrame:
    """Build rows with the quality features of the revision they built."""
    features = schemas.MEASURE_NUMERICS + schemas.MEASURE_CATEGORIES
    wide = measures.select(*on, "analysis_key", *features)
    return _with_analysis(builds, analyses, on).join(wide, [*on, "analysis_key"]).drop("analysis_key")


def flows_x_analyses(flows: DataFrame, analyses: DataFrame) -> DataFrame:
    """Issue flow rows with the revision of their analysis."""
    return flows.join(analyses.select("analysis_key", "revision"), "analysis_key")


def builds_x_flows(
    builds: DataFrame,
    flows: DataFrame,
    analyses: DataFrame,
    keys: list[str] = (),
    on: list[str] = (),
    keep: list[str] = (),
    totals: DataFrame | None = None,
) -> DataFrame:
    """Build outcome with the 72 issue flow features of the built revision.

    ``keys`` are build columns and ``keep`` analysis columns to carry along. ``totals``
    (``running_totals_by_date`` over all flows) are given where the flows lack them; they
    meet the rows of built revisions only.
    """
    extra = [c for c in flows.columns if c == "has_new"]
    outcomes = _with_analysis(builds.select(*on, "revision_number", "result", *keys), analyses, on, keep)
    joined = outcomes.join(flows, [*on, "analysis_key"])
    if totals is not None:
        joined = with_totals(joined, totals, on)
    return joined.select(*on, *keys, "result", *keep, *extra, *schemas.FLOW_FEATURES)


def builds_of_projects(builds: DataFrame, analyses: DataFrame) -> DataFrame:
    """Builds whose revision was analysed by any of the given analyses."""
    return builds.join(
        analyses.select(F.col("revision").alias("revision_number")), "revision_number", "left_semi"
    ).select(*builds.columns)


def label_builds(builds: DataFrame) -> DataFrame:
    return builds.withColumn("result", binary_result(F.col("result")))


def by_batch(df: DataFrame, registry: DataFrame, table: str) -> DataFrame:
    """Rows with the batch number of their organization or server.

    A source named by several batches repeats its rows once per batch. The registry
    is broadcast only after it was counted to be small.
    """
    scope = schemas.SCOPE_COLUMN[table]
    registered = "jenkins_server" if scope == "server" else "sonar_org_key"
    batches = registry.select(F.col(registered).alias(scope), "batch_number").distinct()
    return df.join(F.broadcast(batches) if is_small(batches) else batches, scope)


def union_batches(builds: DataFrame, measures: DataFrame, analyses: DataFrame, registry: DataFrame) -> DataFrame:
    """Build and measure rows of all batches in one join instead of one per batch.

    Batch membership is part of the join keys, so the plan holds each table once
    whatever the number of batches.
    """
    return builds_x_measures(
        by_batch(builds, registry, "jenkins_builds"),
        by_batch(measures, registry, "sonar_measures"),
        by_batch(analyses, registry, "sonar_analyses"),
        on=["batch_number"],
    )
