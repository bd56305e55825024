"""Exact duplicates by deterministic block naming.

Every text, its white space normalised, is cut into fixed-size blocks. Distinct blocks
are sorted into integer names; then adjacent names are paired and the distinct pairs
sorted into names again, until each document has one name and leaves. Two documents of as
many blocks have the same name if and only if their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut_lineage
from .naming import key_sql, proven_keys, sorted_names

BLOCK = 2048


def normalised(text: Column) -> Column:
    """One space for each run of white space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES + "+", " ")


def _blocks(text: str, block: int) -> str:
    count = f"greatest(1, cast(ceil(length({text}) / {block}) as int))"
    return f"transform(sequence(0, {count} - 1), i -> substring({text}, i * {block} + 1, {block}))"


def _block_table(docs: DataFrame, block: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the keys of their blocks, and all distinct block keys."""
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).cast("binary").alias("b"))
    width, keys = proven_keys(text.select(F.explode(F.expr(_blocks("b", block))).alias("x")), "block-keys", bits)
    base = text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.sha2("b", 256).alias("text_sha256"),
        F.expr(f"transform({_blocks('b', block)}, x -> {key_sql(width, bits=bits)})").alias("keys"),
    )
    return cut_lineage(base, "block-rows"), keys.select("key")


def document_names(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """``row, doc_id, text_sha256, blocks, name`` for every row of ``docs``.

    Rounds: the binary logarithm of the blocks of the longest text. Each halves the
    rows; a text with one name left is settled and leaves, so late rounds hold the names
    of very long texts only. A frequent block or pair is combined before it is shuffled
    and joined by an inner join, which Spark splits if it is skewed. ``bits`` are those of
    a hash of a block; results do not hang on them.
    """
    base, keys = _block_table(docs, block, bits)
    names = sorted_names(keys, ["key"], "name", "block-names")
    rows = base.select("row", F.size("keys").alias("left"), F.posexplode("keys").alias("at", "key"))
    rows = rows.join(names, "key").select("row", "left", "at", "name")
    longest = base.agg(F.max(F.size("keys"))).first()[0] or 1
    settled = None
    while longest > 1:
        rows = cut_lineage(rows, "block-ranks")
        done = rows.filter("left = 1").select("row", "name")
        settled = done if settled is None else settled.union(done)
        pairs = rows.filter("left > 1").groupBy("row", F.expr("at div 2").alias("at")).agg(
            F.expr("(first(left) + 1) div 2").cast("int").alias("left"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut_lineage(pairs, "block-pairs")
        names = sorted_names(pairs.select("a", "b").distinct(), ["a", "b"], "name", "pair-names")
        rows = pairs.join(names, ["a", "b"]).select("row", "left", "at", "name")
        longest = (longest + 1) // 2
    rows = rows.select("row", "name")
    rows = rows if settled is None else settled.union(rows)
    return base.select("row", "doc_id", "text_sha256", F.size("keys").alias("blocks")).join(rows, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    Returns for every row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text equals the empty text. A null doc_id comes after all others. If rows
    share text and doc_id, one of them stays. An empty table gives an empty result.
    Other columns are not read, so their names do not matter.
    """
    rows = cut_lineage(document_names(docs, block), "document-names")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = rows.groupBy("blocks", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
    # Written, so that the join below only joins and Spark may split a very large group.
    groups = cut_lineage(groups, "document-groups")
    return rows.join(groups, ["blocks", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
