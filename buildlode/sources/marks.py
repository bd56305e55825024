"""High-water marks kept beside the builds: the latest number of every job.

A load writes the marks of its own builds; the larger number holds, so marks may be merged
in any order and a load that is repeated changes nothing. What is read is one row per job
and load, never the builds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delta import above_marks, latest_build
from .files import listed, move, remove

#: More folders than this are merged into one by the next load.
FOLDERS = 50
MARK = "server string, job string, latest int"


class MarkTable:
    """(server, job, latest) below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        return [p.rpartition("/")[0] for p in listed(self.spark, f"{self.path}/load=*/_SUCCESS")]

    def latest(self) -> DataFrame:
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], MARK)
        rows = self.spark.read.schema(MARK).parquet(*folders)
        return rows.groupBy("server", "job").agg(F.max("latest").alias("latest"))

    def merge(self, builds: DataFrame, load_id: str, folders: int = FOLDERS) -> None:
        """Raise the marks to the numbers of ``builds``, one load."""
        latest_build(builds).select("server", "job", F.col("latest").cast("int")).write.mode("overwrite").parquet(
            f"{self.path}/load={load_id}"
        )
        old = self._folders()
        if len(old) > folders:
            # Under a name no load has; marks read twice do no harm.
            made = f"{self.path}/load=merged-{load_id}"
            self.latest().write.mode("overwrite").parquet(f"{self.path}/_{load_id}")
            move(self.spark, f"{self.path}/_{load_id}", made)
            for folder in old:
                if folder.rpartition("/")[2] != made.rpartition("/")[2]:
                    remove(self.spark, folder)

    def new_builds(self, fetched: DataFrame) -> DataFrame:
        """Fetched builds above the mark of their job."""
        return above_marks(fetched, self.latest())
