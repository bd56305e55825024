"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of the node and its neighbours.

    The large star does so for larger neighbours, the small star for smaller ones. The
    minimum is combined before the shuffle, and the join back is an inner one that Spark
    can split, so a node with very many neighbours is no bottleneck.
    """
    if small:
        both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node reached.

    Rounds grow with the logarithm of the longest path. Each is written to the shared
    folder, so the plan stays short and a lost executor costs a read.
    """
    pairs = cut_lineage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        stats = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now = pairs.agg(stats).first()[0]
        if now == before or not now[0]:
            break
        before = now
        pairs = cut_lineage(_star(cut_lineage(_star(pairs, False), "large-star"), True), "small-star")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select("root", "root")).distinct()
