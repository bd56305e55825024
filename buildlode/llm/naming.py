"""Integer names by sorting: the step that block naming and prefix doubling share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def key_sql(width: int, value: str = "x", bits: int = 64) -> str:
    """The key of ``value``: one hash, or a struct of ``width`` hashes of ``bits`` bits each."""
    parts = [f"xxhash64({seed}, {value})" for seed in range(width)]
    if bits < 64:
        parts = [f"shiftrightunsigned({part}, {64 - bits})" for part in parts]
    return parts[0] if width == 1 else f"struct({', '.join(f'{part} AS h{i}' for i, part in enumerate(parts))})"


def proven_keys(values: DataFrame, label: str, bits: int = 64) -> tuple[int, DataFrame]:
    """The least number of hashes that tell all distinct ``x`` apart, and their keys.

    The values behind each key are compared. If two share a key, another hash is added to
    all keys, so the search ends at any number of values: one hash does for some 1e9 of
    them, two for any table there is. So values cross the network once or twice, later
    steps carry short keys, and keys are free of collisions. Copies are combined before the
    shuffle. Returns the keys with ``n``, how often each value occurs. ``key_sql`` of the
    width makes the key; fewer ``bits`` are for tests.
    """
    width = 1
    while True:
        keys = values.groupBy(F.expr(key_sql(width, bits=bits)).alias("key")).agg(
            F.size(F.collect_set("x")).alias("distinct"), F.count("*").alias("n")
        )
        keys = cut_lineage(keys, label)
        if keys.filter("distinct > 1").isEmpty():
            return width, keys.select("key", "n")
        width += 1


def sorted_names(keys: DataFrame, columns: list[str], name: str, label: str) -> DataFrame:
    """Give every row of ``keys``, distinct in ``columns``, an integer in sort order.

    A range partitioning puts the keys in order over all tasks; the name is the task's
    number and the place in it, so names rise with the keys and no two are equal.
    They have gaps. The table is written once: a lost task reads the same names again.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return cut_lineage(ordered.withColumn(name, F.monotonically_increasing_id()), label)
