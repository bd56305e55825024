"""Stored rows without copies, laid out by row hash.

A row lies in the folder of its bucket, a remainder of its hash, and keeps the hash as a
column. A load is shuffled once, to the layout, and its copies go there. It is compared
with the buckets it touches only: first by hash, which reads eight bytes a stored row, then
column by column for the rows whose hash was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delta import HASH_ROWS
from ..session import cut_lineage, intermediates, is_small
from .files import exists, listed, make_folder

BUCKETS = 32
#: Columns of the layout; no declared column of a table has these names.
LAYOUT = ["bucket", "row_hash", "load_id"]


def row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*columns)


class RowStore:
    """Distinct rows of one table below ``path``; NULL equals NULL.

    ``buckets`` is for a new store; a store that has loads keeps its number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        marks = listed(spark, f"{self.path}/_buckets/*")
        self.buckets = int(marks[0].rpartition("/")[2]) if marks else buckets

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/load_id=*/bucket=*")

    def stored(self) -> DataFrame:
        """All rows with the columns of the layout."""
        return self.spark.read.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.stored().drop(*LAYOUT)

    def placed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with hash and bucket, by the values of ``columns``."""
        return rows.withColumn("row_hash", row_hash(columns)).withColumn("bucket", self.bucket())

    def bucket(self) -> Column:
        return F.pmod("row_hash", F.lit(self.buckets)).cast("int")

    def distinct_rows(self, new: DataFrame, columns: list[str]) -> DataFrame:
        """Distinct placed rows of ``new``, those of a bucket together in a few tasks.

        One shuffle by bucket and slice of the hash serves the copies and the layout, so
        what it gives is written as it lies.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        slices = 4 * -(-tasks // self.buckets)
        rows = self.placed(new.select(*columns), columns).withColumn("slice", F.pmod(F.xxhash64("row_hash"), F.lit(slices)))
        return rows.repartition("bucket", "slice").dropDuplicates().drop("slice")

    def touched(self, load: DataFrame) -> DataFrame:
        """Stored rows of the buckets in which ``load``, placed rows, has any."""
        numbers = [r.bucket for r in load.select("bucket").distinct().collect()]
        return self.stored().where(F.col("bucket").isin(numbers))

    def unstored(self, new: DataFrame, columns: list[str], loads: list[str] | None = None) -> DataFrame:
        """Distinct placed rows of ``new`` that the store lacks.

        ``loads`` names the loads that count as stored; without it all do.
        """
        load = self.distinct_rows(new, columns)
        if not self.exists() or loads == []:
            return load
        return self.lacking(cut_lineage(load.sortWithinPartitions("bucket"), "load"), columns, loads)

    def lacking(self, load: DataFrame, columns: list[str], loads: list[str] | None = None) -> DataFrame:
        """Rows of ``load`` that the store, which has rows, lacks; ``load`` holds distinct
        placed rows that are written out."""
        old = self.touched(load)
        if loads is not None:
            old = old.where(F.col("load_id").isin(loads))
        hashes = load.select("row_hash").distinct()
        few = is_small(hashes, HASH_ROWS)
        found = old.select("row_hash").join(F.broadcast(hashes) if few else hashes, "row_hash", "left_semi").distinct()
        found = cut_lineage(found, "found-hashes")
        if found.isEmpty():
            return load
        # Only rows with a hash on both sides are compared; all others are new.
        both = F.broadcast(found) if is_small(found, HASH_ROWS) else found
        maybe = load.join(both, "row_hash", "left_semi").alias("n")
        known = old.join(both, "row_hash", "left_semi").alias("o")
        same = " AND ".join(["n.row_hash = o.row_hash", *[f"n.`{c}` <=> o.`{c}`" for c in columns]])
        rest = load.join(both, "row_hash", "left_anti").unionByName(maybe.join(known, F.expr(same), "left_anti"))
        return rest.hint("rebalance", "bucket")

    def add(self, rows: DataFrame, load_id: str, **more: Column) -> None:
        """Append rows of ``unstored`` as one load; a load written again replaces its files."""
        make_folder(self.spark, f"{self.path}/_buckets/{self.buckets}")
        placed = rows.withColumns(more).sortWithinPartitions("bucket", "row_hash")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/load_id={load_id}")

    def take(self, new: DataFrame, columns: list[str], load_id: str, loads: list[str] | None = None, **more: Column) -> DataFrame:
        """Add the rows of ``new`` that the store lacks as one load.

        Returns the distinct rows of ``new`` with their hash, whether stored before or not,
        from where they lie: in the load itself if nothing was stored, else in the table of
        the shared folder from which they were compared.
        """
        load = self.distinct_rows(new, columns)
        if not self.exists() or loads == []:
            self.add(load, load_id, **more)
            written = self.spark.read.schema(load.drop("bucket").schema).parquet(f"{self.path}/load_id={load_id}")
            return written.drop("bucket")
        load = cut_lineage(load.sortWithinPartitions("bucket"), "load")
        self.add(self.lacking(load, columns, loads), load_id, **more)
        return load.drop("bucket")

    def merge(self, new: DataFrame, load_id: str, taken: bool = False) -> None:
        """Add the rows of ``new`` that the store lacks. Copies inside ``new`` are stored once.

        With ``taken``, ``new`` is what ``take`` of another store returned: it has no copies
        and is written out, so it is read as it lies, without a shuffle.
        """
        given = [c for c in new.columns if c not in LAYOUT]
        columns = [c for c in self.stored().columns if c not in LAYOUT] if self.exists() else given
        with intermediates(self.spark):
            known = self.exists()
            if taken and columns == given:
                rows = new.withColumn("bucket", self.bucket())
                rows = self.lacking(rows, columns) if known else rows
            else:
                rows = self.unstored(new, columns)
            if not known or not rows.isEmpty():
                self.add(rows, load_id)
