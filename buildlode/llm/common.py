"""What the operators share: document keys, shared-folder tables, bounded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["SPACES", "KEY", "PLAIN", "cut_lineage", "keyed", "join_key", "plain_key", "small_batches", "spread", "wrapped", "fold", "held_out", "labelled_sample", "ordered_turns"]

#: Fixed pattern of the white space that separates words.
SPACES = r"[ \t-\r]"
#: Names no input column should have; the operators own them.
KEY = ("_doc", "_text_hash")


def small_batches(spark) -> None:
    """Send texts to Python in batches of few rows and bytes: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keyed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Document key and text only: ``_doc``, ``_text_hash``, ``text`` (and more).

    A document is its doc_id together with its text; rows that repeat both are one
    document and all get its result. A null text counts as empty. All other input
    columns are left behind, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(text).alias("_text_hash"), text.alias("text"), *more
    )


def wrapped(docs: DataFrame) -> DataFrame:
    """Document key and all columns as one struct ``row``, safe from clashing names."""
    return keyed(docs, F.struct(*(docs[c] for c in docs.columns)).alias("row")).drop("text")


#: The document key without nulls: plain equality, so that a join and what follows it on
#: the same key share one shuffle.
PLAIN = ("_id", "_none", "_text_hash")


def plain_key(df: DataFrame) -> DataFrame:
    """``df`` with its key in the columns PLAIN instead of KEY."""
    named = df.withColumns({"_id": F.coalesce("_doc", F.lit(0)), "_none": F.col("_doc").isNull()})
    return named.drop("_doc")


def join_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join on the document key, keeping the left side's key columns."""
    other = {k: f"{k}_right" for k in KEY}
    right = right.withColumnsRenamed(other)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(other[k])) for k in KEY))
    return left.join(right, same, how).drop(*other.values())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by the keys, as many partitions as the session asks for."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the doc_id as text, modulo 4; 2 marks rows that are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(4))


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def labelled_sample(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` rows of (doc_id, columns), chosen by a hash of the doc_id.

    The choice hangs on nothing but the rows, so a rerun draws the same sample. The
    result is small by construction and may be broadcast.
    """
    picked = rows.filter(F.col("doc_id").isNotNull() & (fold("doc_id") != 2)).select("doc_id", *columns)
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    return picked.orderBy(order, *picked.columns).limit(limit)


def ordered_turns(rows: DataFrame, *more: Column, keep: list[str]) -> DataFrame:
    """``rows`` by conv_id, turn (null first), role and text, written with ``place``.

    Places rise over all rows. Range borders come from ids and turns alone, so no text is
    sampled; a very long conversation is spread over several tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("turn").asc_nulls_first()
    ordered = rows.repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), turn)
    ordered = ordered.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), turn, "role", "text")
    return cut_lineage(ordered.select(F.monotonically_increasing_id().alias("place"), *keep, *more), "turns")
