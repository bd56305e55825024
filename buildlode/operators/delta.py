"""Incremental building blocks: deltas, merges, stamping, high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import is_small
from .quality import label_builds

# Row hashes of a load are broadcast up to this many: eight bytes each.
HASH_ROWS = 1_000_000


def is_new(df_or_flag: DataFrame | Column) -> Column:
    """True for an unprocessed row; a NULL flag does not count as new."""
    flag = df_or_flag["processed"] if isinstance(df_or_flag, DataFrame) else df_or_flag
    return flag.eqNullSafe(F.lit(False))


def unprocessed(df: DataFrame) -> DataFrame:
    return df.where(is_new(df))


def incremental_delta(builds: DataFrame, measures: DataFrame, analyses: DataFrame, on: list[str] = ()) -> DataFrame:
    """Joined rows in which the build, the analysis or the measure is new, each once.

    The narrow tables say which analyses a new build or analysis touches. Of the wide
    measures only rows that are new or touched are joined: if the touched keys were
    counted to be few, they are broadcast and the others never leave their task. Each
    table is read once for the join, the narrow ones once more for the keys.
    """
    features = schemas.MEASURE_NUMERICS + schemas.MEASURE_CATEGORIES
    by_revision, by_key = [*on, "revision"], [*on, "analysis_key"]
    b = label_builds(builds).withColumn("build_new", is_new(builds)).drop(*schemas.BOOKKEEPING)
    b = b.withColumnRenamed("revision_number", "revision")
    a = analyses.where(F.col("analysis_key").isNotNull()).select(
        *by_key, "revision", is_new(analyses).alias("analysis_new")
    )
    m = measures.where(F.col("analysis_key").isNotNull()).select(
        *by_key, *features, is_new(measures).alias("measure_new")
    )
    flags = b.select(*by_revision, "build_new").join(a, by_revision)
    touched = flags.where(F.col("build_new") | F.col("analysis_new")).select(*by_key).distinct()
    if is_small(touched):
        touched = F.broadcast(touched.withColumn("touched", F.lit(True)))
        m = m.join(touched, by_key, "left").where(F.col("measure_new") | F.col("touched")).drop("touched")
    rows = b.join(a, by_revision).join(m, by_key)
    return rows.where(F.col("build_new") | F.col("analysis_new") | F.col("measure_new")).select(
        *[c for c in b.columns if c != "build_new"], *features
    )


def merge_dedup(new: DataFrame, archive: DataFrame) -> DataFrame:
    """Distinct rows of archive and new rows together, NULL equal to NULL.

    Copies already in the archive go too: a first load is stored as it came.
    """
    return archive.unionByName(new.select(*archive.columns)).dropDuplicates()


def not_in_archive(new: DataFrame, archive: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct new rows of which the archive holds no identical copy.

    Rows are compared on all columns, NULL equal to NULL; a 64-bit row hash goes
    first. The archive is first cut to rows that share a hash with a new row: for a
    load counted to be small the hashes are broadcast and the archive is scanned
    without a shuffle, so a load costs by its own size and one scan.
    """
    n = new.select(*columns).dropDuplicates().withColumn("row_hash", F.xxhash64(*columns))
    hashes = n.select("row_hash").distinct()
    old = archive.select(*columns).withColumn("row_hash", F.xxhash64(*columns))
    old = old.join(F.broadcast(hashes) if is_small(hashes, HASH_ROWS) else hashes, "row_hash", "left_semi")
    same = " AND ".join(["n.row_hash = o.row_hash", *[f"n.`{c}` <=> o.`{c}`" for c in columns]])
    return n.alias("n").join(old.alias("o"), F.expr(same), "left_anti").drop("row_hash")


def stamp_processed(df: DataFrame, read_until: Column) -> DataFrame:
    """Next snapshot of a table after a run that read rows ingested up to a date.

    Rows that arrived later keep their flag and are picked up by the next run.
    """
    seen = F.col("ingested_at") <= read_until
    return df.withColumn("processed", F.when(seen, F.lit(True)).otherwise(F.col("processed")))


def latest_build(builds: DataFrame) -> DataFrame:
    """Highest stored build number of every job of every server."""
    return builds.groupBy("server", "job").agg(F.max("build_number").alias("latest"))


def above_high_water_mark(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched builds numbered above the latest stored build of their server and job."""
    return above_marks(fetched, latest_build(stored))


def above_marks(fetched: DataFrame, marks: DataFrame) -> DataFrame:
    """Fetched builds numbered above the mark (server, job, latest) of their job; a job
    without a mark is new."""
    same = fetched["server"].eqNullSafe(marks["server"]) & fetched["job"].eqNullSafe(marks["job"])
    return (
        fetched.join(F.broadcast(marks) if is_small(marks) else marks, same, "left")
        .where(F.col("build_number") > F.coalesce(F.col("latest"), F.lit(-1)))
        .select(*[fetched[c] for c in fetched.columns])
    )
