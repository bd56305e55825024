"""Chi-square test of features against the build outcome, for all groups at once.

Input is long: one row per (group, feature, value) cell with its number of
successful (``ok``) and failed (``failed``) rows. Values a row does not carry count
as zero; those cells are added as the group's totals less what was seen, so sparse
features are never made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_p_value
from ..schemas import TOP_K, ranked_pairs


def outcome_counts(label: str = "label") -> list[Column]:
    return [F.count_if(F.col(label) == 0.0).alias("ok"), F.count_if(F.col(label) == 1.0).alias("failed")]


def _term(ok: Column, failed: Column) -> Column:
    """Sum over both outcomes of (observed - expected)^2 / expected for one value."""
    rows, total = ok + failed, F.col("all_ok") + F.col("all_failed")
    expected_ok = rows * F.col("all_ok") / total
    expected_failed = rows * F.col("all_failed") / total
    return (ok - expected_ok) ** 2 / expected_ok + (failed - expected_failed) ** 2 / expected_failed


def chi_square(cells: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., feature, statistic, dof) from value cells and per-group totals.

    ``totals`` has ``keys`` with ``ok`` and ``failed`` over all rows of the group. A
    feature with one value, or a group with one outcome, has statistic 0 and dof 0.
    """
    all_rows = totals.select(*keys, F.col("ok").alias("all_ok"), F.col("failed").alias("all_failed"))
    if keys:
        joined = cells.join(all_rows, keys)
    else:  # one row of totals, read once
        row = all_rows.first()
        joined = cells.withColumns({c: F.lit(row[c]) for c in ("all_ok", "all_failed")})
    both = (F.col("all_ok") > 0) & (F.col("all_failed") > 0)
    seen = joined.groupBy(*keys, "feature").agg(
        F.sum(F.when(both, _term(F.col("ok"), F.col("failed")))).alias("seen_statistic"),
        F.sum("ok").alias("seen_ok"),
        F.sum("failed").alias("seen_failed"),
        F.count("*").alias("seen_values"),
        F.first("all_ok").alias("all_ok"),
        F.first("all_failed").alias("all_failed"),
    )
    rest_ok = F.col("all_ok") - F.col("seen_ok")
    rest_failed = F.col("all_failed") - F.col("seen_failed")
    has_rest = rest_ok + rest_failed > 0
    values = F.col("seen_values") + F.when(has_rest, 1).otherwise(0)
    testable = both & (values > 1)
    statistic = F.col("seen_statistic") + F.when(has_rest, _term(rest_ok, rest_failed)).otherwise(0.0)
    return seen.select(
        *keys,
        "feature",
        F.when(testable, statistic).otherwise(0.0).alias("statistic"),
        F.when(testable, values - 1).otherwise(0).cast("int").alias("dof"),
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_p_value("statistic", "dof"))


def value_cells(samples: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Cells of wide samples: (keys..., feature, value, ok, failed)."""
    narrow = samples.selectExpr(*keys, "label", *[f"cast(`{f}` AS double) AS `{f}`" for f in features])
    return (
        narrow.unpivot([*keys, "label"], features, "feature", "value")
        .groupBy(*keys, "feature", "value")
        .agg(*outcome_counts())
    )


def top_ranked(scores: DataFrame, keys: list[str], order: list[Column], k: int = TOP_K) -> DataFrame:
    """Rows with ``rank`` 1..k per group; the cut runs before the shuffle too."""
    if not keys:
        # A global top k: every task keeps k rows, one task ranks what is left of them.
        return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def top10_chi2(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Ten most telling features per group: lowest p-value, then largest statistic.

    Both are ranked at twelve decimals, so the last bits of a sum cannot swap two features.
    """
    scored = with_p_value(tests)
    order = [F.round("p_value", 12).asc(), F.round("statistic", 12).desc(), F.asc("feature")]
    return top_ranked(scored, keys, order)


def widen_ranked(ranked: DataFrame, keys: list[str], name: str, value: str, out_name: str, out_value: str) -> DataFrame:
    """One row per group with (name_1, value_1) ... (name_10, value_10), NULL-padded."""
    cells = []
    for i, (n, v) in enumerate(ranked_pairs(out_name, out_value), 1):
        cells.append(F.expr(f"max({name}) FILTER (WHERE rank = {i}) AS {n}"))
        cells.append(F.expr(f"max(cast({value} AS double)) FILTER (WHERE rank = {i}) AS {v}"))
    return ranked.groupBy(*keys).agg(*cells)
