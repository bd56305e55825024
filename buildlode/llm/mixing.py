"""Mix sources to target weights by Pareto order sampling, in DataFrame functions only.

A source gets ``floor(target / size)`` whole copies of each document for certain. What
is left of the target is filled by a Pareto sample: documents have inclusion
probabilities in proportion to their size (at most 1), are ranked by their random odds
divided by their inclusion odds, and are taken in that order up to the words wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small
from .common import cut_lineage

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Rank classes of a source: only the class that the cut falls in is sorted.
CLASSES = 4096
SEED = "mix-1"

WORD = r"[^ \t-\r]+"


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a random number in (0, 1) that hangs on the row only."""
    size = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    doc, source = docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return docs.select(doc, source, size.alias("size"), ((draw.cast("double") + 0.5) / float(1 << 52)).alias("u"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row per source.

    A source with weight w gets ``level * w`` words, at most ``most`` times its size; the
    level makes the targets add up to all words. Sources reach their bound in the order
    of size / weight, so the level follows from running sums in that order. The windows
    here run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, bound = F.sum("source_size").over(every), F.lit(most) * F.col("source_size")
    left = total - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # The level if all sources before this one are at their bound and this one is not.
    per = per.withColumn("level", left / free).withColumn("fits", F.col("level") * F.col("weight") <= bound)
    level = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * 1.0 / F.col("weight"), "level"))).over(every)
    share = F.col("cut.level") * F.col("weight")
    target = F.when(F.col("cut").isNull() | (share > bound), bound.cast("double")).otherwise(share)
    return per.withColumn("cut", level).select("source", "source_size", target.alias("target"))


def _inclusion(wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, factor: inclusion probability is min(1, factor * size).

    Documents whose probability would pass 1 are certain; the factor makes the expected
    words of all equal those wanted. It is found on one row per source and distinct size.
    """
    hist = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = F.sum(F.col("size") * F.col("n"))
    certain = F.coalesce(words.over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("n"))
    rest = squares.over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    hist = hist.join(wanted, hist["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    hist = hist.withColumn("factor", (F.col("rest_words") - certain) / rest)
    ok = (F.col("factor") * F.col("size") <= 1) & (F.col("factor") >= 0)
    return hist.groupBy("source").agg(F.max_by("factor", F.when(ok, F.col("size"))).alias("factor"))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    ``taken`` counts the words the mix takes of a document, repeats included. The words
    taken of a source differ from its target by less than its largest document.

    A null text has size 0 and is never taken. A null source is a source of its own, the
    last. Rows that repeat a doc_id draw the same number; ties are cut by doc_id and size,
    and equal rows are interchangeable. An empty table gives an empty result; a source
    without words has target 0. Other columns are not read.
    """
    sizes = cut_lineage(_sizes(docs), "mix-sizes")
    plan = cut_lineage(targets(sizes, weights, most).withColumn("copies", _whole()).withColumn(
        "rest_words", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    chance = _inclusion(plan.select("source", "rest_words"), sizes)
    plan = plan.join(chance, plan["source"].eqNullSafe(chance["source"]), "left").drop(chance["source"])
    plan = cut_lineage(plan, "mix-plan")
    # One row per source: broadcast if they were counted to be few, else an inner join
    # that Spark splits where a source is very large.
    side = F.broadcast(plan) if is_small(plan) else plan
    rows = sizes.join(side, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    p = F.least(F.coalesce(F.col("factor"), F.lit(0.0)) * F.col("size"), F.lit(1.0))
    # Random odds over inclusion odds, as a number from 0 (first) to 1 (never).
    ratio = _odds(F.col("u")) / _odds(F.col("p"))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") <= 0, 1.0).otherwise(ratio / (1 + ratio))
    rows = rows.withColumn("p", p).withColumn("rank", rank)
    # Certain documents, class -1, fit by construction; those never drawn come last.
    place = F.when(F.col("p") >= 1, -1).otherwise(F.floor(F.col("rank") * CLASSES)).cast("int")
    rows = rows.withColumn("class", place)
    rows = cut_lineage(rows.drop("u", "factor", "p"), "mix-ranks")

    # Words before each class of a source: at most CLASSES rows a source.
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    same = rows["source"].eqNullSafe(classes["source"]) & (rows["class"] == classes["class"])
    rows = rows.join(classes, same).drop(classes["source"], classes["class"])
    sure = F.col("before") + F.col("words") <= F.col("rest_words")
    never = F.col("before") >= F.col("rest_words")
    cut = ~sure & ~never
    order = Window.partitionBy("source", "class").orderBy("rank", "doc_id", "size")
    running = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = rows.filter(cut).withColumn("more", (running - F.col("size") / 2.0 <= F.col("rest_words")).cast("long"))
    rest = rows.filter(~cut).withColumn("more", sure.cast("long"))
    return near.unionByName(rest).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("more"))).alias("taken")
    )


def _whole() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
