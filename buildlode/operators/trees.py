"""Shallow decision trees for every project at once, grown level by level.

``pyspark.ml`` fits one model per call, so a model per project would be a driver
loop with several jobs each. Here one level of all trees of all projects is one
set of aggregations: label counts per (tree, node, feature, value), best split per
node, rows moved to the child nodes. Samples are analyses with their numbers of
successful and failed builds; features are sparse counts, absent means zero.

Splits follow the usual rules: Gini impurity, candidate cuts half way between
neighbouring values, a node is split while its best gain is positive.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RESOLUTION = 1 << 30
# Number of the single tree where it grows beside a forest.
SINGLE = -1


def poisson_steps() -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, as far as a drawn number can tell."""
    steps, term, k = [], math.exp(-1), 0
    while (steps[-1] if steps else 0.0) < 1 - 1 / RESOLUTION:
        steps.append(min(1.0, (steps[-1] if steps else 0.0) + term))
        k += 1
        term /= k
    return steps


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values only, so retries repeat it."""
    return F.pmod(F.xxhash64(*parts), F.lit(RESOLUTION)) / float(RESOLUTION)


def single_tree_weights(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of one tree over all rows: (keys, tree, analysis_key, ok, failed)."""
    return outcomes.groupBy(*keys, "analysis_key").agg(
        F.count_if(F.col("label") == 0.0).alias("ok"), F.count_if(F.col("label") == 1.0).alias("failed")
    ).withColumn("tree", F.lit(0))


def bootstrap_weights(outcomes: DataFrame, keys: list[str], trees: int, row_key: str, seed: int) -> DataFrame:
    """Poisson(1) bootstrap of every row for every tree, summed per analysis."""
    drawn = outcomes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    u = uniform_hash(F.lit(seed), F.col("tree"), F.col(row_key), F.col("analysis_key"))
    weight = reduce(add, [F.when(u >= step, 1).otherwise(0) for step in poisson_steps()])
    return (
        drawn.withColumn("weight", weight)
        .where(F.col("weight") > 0)
        .groupBy(*keys, "tree", "analysis_key")
        .agg(
            F.sum(F.when(F.col("label") == 0.0, F.col("weight")).otherwise(0)).alias("ok"),
            F.sum(F.when(F.col("label") == 1.0, F.col("weight")).otherwise(0)).alias("failed"),
        )
    )


def feature_subsets(spark, features: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(tree, node, slot): a random square-root share of the features per node.

    At most trees x 2^depth x sqrt(features) rows, whatever the data.
    """
    size = math.ceil(math.sqrt(features))
    slots = (
        spark.range(features)
        .select(F.col("id").cast("int").alias("slot"))
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(2**depth - 1))))
    )
    order = Window.partitionBy("tree", "node").orderBy(uniform_hash(F.lit(seed), F.col("tree"), F.col("node"), F.col("slot")), "slot")
    return slots.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("tree", "node", "slot")


def all_features(spark, features: int, depth: int) -> DataFrame:
    """(tree, node, slot) of the single tree: every feature at every node."""
    slots = spark.range(features).select(F.lit(SINGLE).alias("tree"), F.col("id").cast("int").alias("slot"))
    return slots.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(2**depth - 1))))


def _gini(ok: Column, failed: Column) -> Column:
    total = ok + failed
    return 1.0 - (ok / total) ** 2 - (failed / total) ** 2


def _packed(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per analysis: its ``trees`` (tree, node, ok, failed) and its ``cells`` (slot to n).

    An array holds at most a row per tree, a map at most a cell per feature. All levels
    read this table; the two sides are shuffled and joined once.
    """
    analysis = [*keys, "analysis_key"]
    trees = rows.groupBy(*analysis).agg(
        F.collect_list(F.struct("tree", F.lit(1).alias("node"), "ok", "failed")).alias("trees")
    )
    seen = cells.groupBy(*analysis).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("cells"))
    return trees.join(seen, analysis, "left")


def _moved(packed: DataFrame, splits: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The packed rows with their trees in the child nodes; a tree whose node has no split goes."""
    # A project's splits as an array, to be read by the place of a tree's node.
    place = f"cast((tree - {SINGLE}) * {2**depth} + node AS int)"
    by_key = splits.groupBy(*keys).agg(
        F.expr(f"map_from_entries(collect_list(struct({place}, struct(slot, cut)))) AS placed"),
        F.expr(f"max({place}) AS last"),
    ).selectExpr(*keys, "transform(sequence(0, last), i -> try_element_at(placed, i)) AS splits")
    joined = packed.join(by_key, keys) if keys else packed.crossJoin(by_key)
    at = place.replace("tree", "t.tree").replace("node", "t.node")
    met = f"""filter(transform(trees, t -> named_struct('t', t, 'split', get(splits, {at}))), m -> m.split IS NOT NULL)"""
    right = "CASE WHEN coalesce(try_element_at(cells, m.split.slot), 0L) > m.split.cut THEN 1 ELSE 0 END"
    return joined.selectExpr(
        *keys,
        "analysis_key",
        f"transform({met}, m -> struct(m.t.tree AS tree, m.t.node * 2 + {right} AS node, m.t.ok AS ok, m.t.failed AS failed)) AS trees",
        "cells",
    ).where("size(trees) > 0")


def _best_splits(packed: DataFrame, keys: list[str], subsets: DataFrame | None) -> DataFrame:
    """(keys, tree, node, slot, cut, gain, weight) of every node that gains by a split."""
    node, feature = [*keys, "tree", "node"], [*keys, "tree", "node", "slot"]
    rows = packed.selectExpr(*keys, "cells", "inline(trees)")
    totals = rows.groupBy(*node).agg(F.sum("ok").alias("all_ok"), F.sum("failed").alias("all_failed")).where(
        (F.col("all_ok") > 0) & (F.col("all_failed") > 0)
    )
    joined = rows.selectExpr(*node, "ok", "failed", "explode(cells) AS (slot, n)")
    if subsets is not None:
        joined = joined.join(F.broadcast(subsets), ["tree", "node", "slot"])
    values = joined.groupBy(*feature, "n").agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))

    # Rows that lack the feature have the value zero, below all values seen.
    seen = values.groupBy(*feature).agg(F.sum("ok").alias("seen_ok"), F.sum("failed").alias("seen_failed"))
    zeros = seen.join(totals, node).select(
        *feature,
        F.lit(0).cast("bigint").alias("n"),
        (F.col("all_ok") - F.col("seen_ok")).alias("ok"),
        (F.col("all_failed") - F.col("seen_failed")).alias("failed"),
    ).where(F.col("ok") + F.col("failed") > 0)

    by_value = Window.partitionBy(*feature).orderBy("n")
    cuts = values.unionByName(zeros).select(
        *feature,
        ((F.col("n") + F.lead("n").over(by_value)) / 2).alias("cut"),
        F.sum("ok").over(by_value).alias("left_ok"),
        F.sum("failed").over(by_value).alias("left_failed"),
    ).where(F.col("cut").isNotNull())

    weight = F.col("all_ok") + F.col("all_failed")
    left = F.col("left_ok") + F.col("left_failed")
    gain = (
        _gini(F.col("all_ok"), F.col("all_failed"))
        - left / weight * _gini(F.col("left_ok"), F.col("left_failed"))
        - (weight - left) / weight * _gini(F.col("all_ok") - F.col("left_ok"), F.col("all_failed") - F.col("left_failed"))
    )
    # Largest gain; among equals the first feature and its lowest cut.
    best = F.max(F.struct("gain", (-F.col("slot")).alias("s"), (-F.col("cut")).alias("c"))).alias("best")
    return (
        cuts.join(totals, node)
        .withColumns({"gain": F.round(gain, 12), "weight": weight})
        .where(F.col("gain") > 0)
        .groupBy(*node)
        .agg(best, F.first("weight").alias("weight"))
        .select(*node, (-F.col("best.s")).alias("slot"), (-F.col("best.c")).alias("cut"), F.col("best.gain").alias("gain"), "weight")
    )


def grow(rows: DataFrame, cells: DataFrame, keys: list[str], depth: int, subsets: DataFrame | None = None) -> DataFrame:
    """All splits of all trees: (keys, tree, node, slot, cut, gain, weight).

    ``rows``: (keys, tree, analysis_key, ok, failed), one per tree of an analysis;
    ``cells``: (keys, analysis_key, slot, n) with n > 0, one per slot. Node 1 is the root,
    node i has children 2i and 2i + 1. Rows and splits are written to the shared folder
    after each level.
    """
    packed = _packed(rows, cells, keys)
    levels = []
    for level in range(depth):
        packed = cut_lineage(packed, "tree-rows")
        splits = cut_lineage(_best_splits(packed, keys, subsets), "tree-splits")
        levels.append(splits)
        if level + 1 < depth:
            packed = _moved(packed, splits, keys, depth)
    grown = levels[0]
    for more in levels[1:]:
        grown = grown.unionByName(more)
    return grown


def importances(splits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, importance): gain times node weight, each tree's share summing to 1,
    then the mean over trees, again summing to 1."""
    per_tree = splits.groupBy(*keys, "tree", "slot").agg(F.sum(F.col("gain") * F.col("weight")).alias("part"))
    of_tree, of_group = Window.partitionBy(*keys, "tree"), Window.partitionBy(*keys)
    shares = per_tree.withColumn("part", F.col("part") / F.sum("part").over(of_tree))
    summed = shares.groupBy(*keys, "slot").agg(F.sum("part").alias("importance"))
    return summed.withColumn("importance", F.col("importance") / F.sum("importance").over(of_group))
