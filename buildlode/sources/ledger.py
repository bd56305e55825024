"""Which loads a study holds and which of them its runs have read.

Rows carry the id of their load and never change. A load counts from the moment it is
entered here, so files of a load that failed half-way are never read. A run writes down
the loads it starts from; once it is finished they are processed. What arrives meanwhile
belongs to no such list and is new to the next run.
"""

from __future__ import annotations

import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .files import exists
from .store import LAYOUT, RowStore

LOADS = "load_id string, table_name string"
PINNED = "run_id string, load_id string, table_name string"
FINISHED = "run_id string"
_WRITER = Lock()


def new_id(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex[:16]}"


class LoadLedger:
    """Small tables below ``root``/_ledger; their rows count loads, not data."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/_ledger/{name}"
        if not exists(self.spark, f"{path}/*.parquet"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, rows: DataFrame) -> None:
        # Two writers of one folder would share, and remove, its temporary files.
        with _WRITER:
            rows.coalesce(1).write.mode("append").parquet(f"{self.root}/_ledger/{name}")

    def loads(self, table: str) -> list[str]:
        """Ids of the loads of a table."""
        rows = self._table("loads", LOADS).where(F.col("table_name") == table).select("load_id").distinct()
        return sorted(r.load_id for r in rows.collect())

    def enter(self, load_id: str, table: str) -> None:
        """From now on the rows of the load count."""
        self._append("loads", self.spark.createDataFrame([(load_id, table)], LOADS))

    def begin(self) -> str:
        """A new run, which reads the loads entered so far."""
        run = new_id("run")
        self._append("pinned", self._table("loads", LOADS).distinct().select(F.lit(run).alias("run_id"), "load_id", "table_name"))
        return run

    def finish(self, run: str) -> None:
        """The loads of the run are processed."""
        self._append("finished", self.spark.createDataFrame([(run,)], FINISHED))

    def pinned(self, run: str, table: str) -> list[str]:
        rows = self._table("pinned", PINNED).where((F.col("run_id") == run) & (F.col("table_name") == table))
        return sorted(r.load_id for r in rows.select("load_id").distinct().collect())

    def processed(self, table: str) -> list[str]:
        """Loads of a table that a finished run has read."""
        rows = self._table("pinned", PINNED).where(F.col("table_name") == table)
        done = rows.join(self._table("finished", FINISHED), "run_id", "left_semi").select("load_id").distinct()
        return sorted(r.load_id for r in done.collect())


class LedgerTables:
    """Stored tables as a run sees them: its pinned loads, or all entered ones.

    ``processed`` is whether a finished run has read the row's load. It hangs on the load
    folder alone, so a filter on it leaves out whole folders.
    """

    def __init__(self, ledger: LoadLedger, run: str | None = None):
        self.ledger, self.run = ledger, run

    def table(self, name: str) -> DataFrame:
        ledger, path = self.ledger, f"{self.ledger.root}/{name}"
        if name not in schemas.STAMPED_TABLES:
            # Kept by hand, such as the list of sources: not loaded, never processed.
            return ledger.spark.read.parquet(path)
        seen = ledger.loads(name) if self.run is None else ledger.pinned(self.run, name)
        if not RowStore(ledger.spark, path).exists():
            return ledger.spark.createDataFrame([], schemas.stored(name))
        rows = ledger.spark.read.parquet(path).where(F.col("load_id").isin(seen))
        return rows.withColumn("processed", F.col("load_id").isin(ledger.processed(name))).drop(*LAYOUT)
