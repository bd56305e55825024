"""Classification metrics as one aggregation over scored rows.

Scored rows have ``label`` and ``prediction`` in {0.0, 1.0}; 1.0 is a failed build.
An optional weight stands for repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(scored: DataFrame, keys: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Row, actual, predicted and hit counts of both classes, in a single pass."""
    w = F.lit(1) if weight is None else weight
    label, prediction = F.col("label"), F.col("prediction")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")

    return scored.groupBy(*keys).agg(
        total(F.lit(True)).alias("n"),
        total(label == 0.0).alias("actual_ok"),
        total(label == 1.0).alias("actual_failed"),
        total(prediction == 0.0).alias("predicted_ok"),
        total(prediction == 1.0).alias("predicted_failed"),
        total((label == 0.0) & (prediction == 0.0)).alias("hit_ok"),
        total((label == 1.0) & (prediction == 1.0)).alias("hit_failed"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def multiclass_metrics(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Weighted f1, precision, recall and accuracy from confusion counts."""
    weighted = {"f1": [], "weighted_precision": [], "weighted_recall": []}
    for c in ("ok", "failed"):
        hit, actual, predicted = F.col(f"hit_{c}"), F.col(f"actual_{c}"), F.col(f"predicted_{c}")
        precision, recall = _share(hit, predicted), _share(hit, actual)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        share = actual / F.col("n")
        weighted["f1"].append(f1 * share)
        weighted["weighted_precision"].append(precision * share)
        weighted["weighted_recall"].append(recall * share)
    return counts.select(
        *keys,
        "n",
        *[(a + b).alias(name) for name, (a, b) in weighted.items()],
        ((F.col("hit_ok") + F.col("hit_failed")) / F.col("n")).alias("accuracy"),
        predicted_negative_rate().alias("predicted_negative_rate"),
    )


def predicted_negative_rate() -> Column:
    """Share of failed builds that were predicted to fail; NULL without any."""
    return F.when(F.col("actual_failed") > 0, F.col("hit_failed") / F.col("actual_failed"))


def score_table(scored: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted rows per (keys..., score, label, prediction): all a report needs.

    Scores are not rounded; equal ones are combined before the shuffle. ``range`` numbers
    ranges of falling scores of like size, which only spread the work. They hang on a
    sample, so the table must be written before it is used twice.
    """
    w = F.lit(1) if weight is None else weight
    table = scored.groupBy(*keys, "score", "label", "prediction").agg(F.sum(w).cast("bigint").alias("rows"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.repartitionByRange(parts, *[F.asc(k) for k in keys], F.desc("score"))
    return ranged.withColumn("range", F.spark_partition_id())


def binary_areas(table: DataFrame, keys: list[str]) -> DataFrame:
    """Exact areas under the ROC and precision/recall curve per key, by trapezoids.

    Counts are summed per range, ranges accumulate within a key, scores within their
    range. No window holds more than the ranges of a key or the scores of a range. The
    curves start at (0, 0) and at recall 0 with the first precision.
    """
    per_score = table.groupBy(*keys, "range", "score").agg(
        F.sum(F.when(F.col("label") == 1.0, F.col("rows")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0.0, F.col("rows")).otherwise(0)).alias("neg"),
    )
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_score.groupBy(*keys, "range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranges = ranges.select(
        *keys,
        "range",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("pos", "neg")],
    )
    down = Window.partitionBy(*keys, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    points = per_score.join(ranges, [*keys, "range"]).select(
        *keys,
        "all_pos",
        "all_neg",
        "pos",
        "neg",
        (F.col("pos_before") + F.sum("pos").over(down)).alias("tp"),
        (F.col("neg_before") + F.sum("neg").over(down)).alias("fp"),
    )
    last_tp, last_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    last_precision = F.when(last_tp + last_fp > 0, last_tp / (last_tp + last_fp)).otherwise(precision)
    recall, last_recall = _share(F.col("tp"), F.col("all_pos")), _share(last_tp, F.col("all_pos"))
    fall_out, last_fall_out = _share(F.col("fp"), F.col("all_neg")), _share(last_fp, F.col("all_neg"))
    roc = (fall_out - last_fall_out) * (recall + last_recall) / 2
    pr = (recall - last_recall) * (precision + last_precision) / 2
    return points.groupBy(*keys).agg(F.sum(roc).alias("area_under_ROC"), F.sum(pr).alias("area_under_PR"))


def full_report(table: DataFrame, keys: list[str]) -> DataFrame:
    """All seven metrics and the row count ``n`` per key."""
    counts = confusion_counts(table, keys, F.col("rows"))
    return multiclass_metrics(counts, keys).join(binary_areas(table, keys), keys)
