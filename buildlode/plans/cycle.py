"""The full cycle of a study: load what is staged, run the models, archive, note it down."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..session import apart, at_once, intermediates
from ..sources import staging
from ..sources.ledger import LedgerTables, LoadLedger
from ..sources.marks import MarkTable


def run_cycle(
    spark: SparkSession,
    staged_root: str,
    root: str,
    archive_root: str,
    models: Callable[[LedgerTables], object],
    tables: list[str] = schemas.STAMPED_TABLES,
    rejects: str | None = None,
):
    """Load staged files, call ``models`` on the stored tables, archive the files.

    Files are listed once: those are loaded, and those alone are merged into the archive
    and renamed. The models see the loads entered before they start. Both the files staged
    and the loads entered in the meantime are left to the next cycle, where their rows are
    new. No table is rewritten: the ledger notes what was read, after everything else, so
    a cycle that fails is read again as a whole. Rows are loaded once all the same, since
    a load leaves out what is stored.

    Staged files are parsed once: the marks and the archive take the distinct rows that the
    load has sorted out. Tables do not hang on each other and are loaded, and later
    archived, side by side.

    A row that cannot be read ends the cycle before anything is stored; with ``rejects``, a
    folder, such rows are set aside there instead (``staging.staged_csv_split``).

    Returns what ``models`` returns, for example
    ``lambda t: jobs.run_all(jobs.Study(spark, t, artefacts, results))``.
    """
    root, archive_root = root.rstrip("/"), archive_root.rstrip("/")
    ledger = LoadLedger(spark, root)
    files = {table: staging.staged_files(spark, staged_root, table) for table in tables}
    stored = {table: ledger.loads(table) for table in tables}
    due = [table for table in tables if files[table] or not stored[table]]
    with intermediates(spark):
        # Distinct rows are kept until the archive has them; what the models make is theirs.
        loads = at_once(spark, *[partial(_load, spark, root, table, files[table], stored[table], rejects) for table in due])
        for table, (load_id, rows) in zip(due, loads):
            ledger.enter(load_id, table)
            if table == "jenkins_builds":
                MarkTable(spark, f"{root}/_marks").merge(rows, load_id)
        run = ledger.begin()
        with apart():
            out = models(LedgerTables(ledger, run))
        at_once(spark, *[partial(_archive, spark, archive_root, table, files[table], rows) for table, (_, rows) in zip(due, loads) if files[table]])
    ledger.finish(run)
    return out


def _load(spark: SparkSession, root: str, table: str, files: list[str], loads: list[str], rejects: str | None) -> tuple[str, DataFrame]:
    """The id of the stored load and the distinct rows of the files."""
    return staging.store_load(_read(spark, files, table, rejects), f"{root}/{table}", table, loads)


def _archive(spark: SparkSession, archive_root: str, table: str, files: list[str], rows: DataFrame) -> None:
    staging.merge_into_archive(rows, f"{archive_root}/{table}", taken=True)
    staging.archive_staged(spark, files)


def _read(spark: SparkSession, paths: list[str], table: str, rejects: str | None) -> DataFrame:
    if rejects is None:
        return staging.staged_csv_read(spark, paths, table).drop("staged_file")
    return staging.staged_csv_split(spark, paths, table, rejects).drop("staged_file")
