"""Staged CSV files: where they lie, reading, writing and loading them.

Layout below one data root::

    sonarcloud/<organization>/{analyses,measures,issues}/<name>_staging.csv
    jenkins/<server host>/{builds,tests}/<job>_<kind>_staging.csv

A ``*_staging.csv`` may be a single file or a folder of part files as Spark writes
it. Once merged, staged rows live in the archive and the name loses ``_staging``.
"""

from __future__ import annotations

import csv
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalars import slug
from ..session import cut_lineage, intermediates
from .files import data_files, exists, first_line, listed, move, remove
from .ledger import LoadLedger, new_id
from .store import RowStore

# Folder of every staged table below the data root.
LAYOUT = {
    "sonar_analyses": ("sonarcloud", "analyses"),
    "sonar_measures": ("sonarcloud", "measures"),
    "sonar_issues": ("sonarcloud", "issues"),
    "jenkins_builds": ("jenkins", "builds"),
    "jenkins_tests": ("jenkins", "tests"),
}

# Quoting as the crawlers write it: quotes doubled, empty cell is NULL. A cell may hold
# line breaks. A row that does not fit its header ends the read; nothing becomes NULL.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def staged_path(root: str, table: str, scope: str = "*", all_files: bool = False) -> str:
    origin, kind = LAYOUT[table]
    return f"{root.rstrip('/')}/{origin}/{scope}/{kind}/{'*.csv' if all_files else '*_staging.csv'}"


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Files by their header line, taken from the first bytes of each file. Files are
    counted by the crawlers, not by the rows; several are opened at a time."""
    patterns = [paths] if isinstance(paths, str) else paths
    files = sorted({f for p in patterns for place in listed(spark, p) for f in data_files(spark, place)})
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    found: dict[str, list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        found.setdefault(line.rstrip(), []).append(file)
    return found


#: A row's own text, where it does not fit the header.
CORRUPT = "_corrupt_record"


def _typed(spark: SparkSession, paths: str | list[str], table: str, lenient: bool) -> DataFrame:
    """Declared columns and ``staged_file``; if lenient, ``problem`` and ``record`` too."""
    schema = schemas.TABLES[table]
    parts = []
    for header, files in sorted(_headers(spark, paths).items()) if paths else ():
        names = next(csv.reader([header.lstrip("\ufeff")]), [])
        missing = set(schema.names) - set(names)
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {sorted(missing)} of {table}")
        texts = [T.StructField(n, T.StringType()) for n in names]
        options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if lenient else CSV_OPTIONS
        whole = [T.StructField(CORRUPT, T.StringType())] if lenient else []
        rows = spark.read.schema(T.StructType([*texts, *whole])).options(**options).csv(files)
        cells = {f.name: F.col(f"`{f.name}`") for f in schema}
        filled = {f.name: c if f.dataType == T.StringType() else F.nullif(F.trim(c), F.lit("")) for f, c in zip(schema, cells.values())}
        cast = {f.name: filled[f.name].try_cast(f.dataType) if lenient else filled[f.name].cast(f.dataType) for f in schema}
        more = []
        if lenient:
            bad = [F.when(filled[n].isNotNull() & cast[n].isNull(), F.lit(n)) for n in schema.names]
            unfit = F.when(F.col(CORRUPT).isNotNull(), F.lit("cells"))
            problem = F.nullif(F.concat_ws(",", unfit, *bad), F.lit(""))
            # Only a rejected row is kept as text too.
            record = F.when(problem.isNotNull(), F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*cells.values()))))
            more = [problem.alias("problem"), record.alias("record")]
        parts.append(rows.select(*[c.alias(n) for n, c in cast.items()], F.col("_metadata.file_path").alias("staged_file"), *more))
    if not parts:
        names = ["staged_file", "problem", "record"] if lenient else ["staged_file"]
        return spark.createDataFrame([], T.StructType([*schema.fields, *(T.StructField(n, T.StringType()) for n in names)]))
    return reduce(DataFrame.unionByName, parts)


def staged_csv_read(spark: SparkSession, paths: str | list[str], table: str) -> DataFrame:
    """Rows of staged files with the declared columns and types, and their file.

    Columns are taken by name: a file may have them in any order and have others. A
    missing column or a cell that its type cannot hold ends the read.
    """
    return _typed(spark, paths, table, lenient=False)


def staged_csv_split(spark: SparkSession, paths: str | list[str], table: str, rejects: str) -> DataFrame:
    """The readable rows; the others go to the table ``rejects`` and do not end the load.

    A rejected row is stored with its file, its problem (the columns whose cell its type
    cannot hold; ``cells`` if it has too few or too many) and its record as text. Files
    that lack a declared column still end the read. Blank cells are NULL, not rejected.
    The files are parsed once: both sides are written, and reading again the files that
    were read replaces their rejected rows.
    """
    read = cut_lineage(_typed(spark, paths, table, lenient=True), "staged-rows")
    is_bad = F.col("problem").isNotNull()
    bad = read.where(is_bad).select("staged_file", "problem", "record").withColumn("file_id", F.md5("staged_file"))
    bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(f"{rejects}/{table}")
    return read.where(~is_bad).drop("problem", "record")


def reject_counts(spark: SparkSession, rejects: str, table: str) -> DataFrame:
    """Rejected rows per file and problem."""
    path = f"{rejects}/{table}"
    if not exists(spark, f"{path}/file_id=*"):
        return spark.createDataFrame([], "staged_file string, problem string, n bigint")
    return spark.read.parquet(path).groupBy("staged_file", "problem").agg(F.count("*").alias("n"))


def _staged(spark: SparkSession, root: str, table: str, all_files: bool) -> DataFrame:
    path = staged_path(root, table, all_files=all_files)
    return staged_csv_read(spark, path if exists(spark, path) else [], table)


def staged_csv_scan(spark: SparkSession, root: str, table: str, all_files: bool = False) -> DataFrame:
    """Staged rows of a table; ``all_files`` reads archive files too."""
    return _staged(spark, root, table, all_files).drop("staged_file")


def staged_layout_scan(spark: SparkSession, root: str, all_files: bool = False) -> dict[str, DataFrame]:
    """All staged tables, each row with the organization or server folder it came from."""
    out = {}
    for table, (origin, kind) in LAYOUT.items():
        if exists(spark, staged_path(root, table, all_files=all_files)):
            owner = F.regexp_extract("staged_file", f"/{origin}/([^/]+)/{kind}/", 1)
            out[table] = _staged(spark, root, table, all_files).withColumn("scope_folder", owner).drop("staged_file")
    return out


def staged_table_write(df: DataFrame, root: str, table: str, scope: Column | str, name: Column | str) -> None:
    """Write staged rows of any number of owners in one pass, one ``*_staging.csv`` each.

    ``scope`` gives the organization or server folder of a row and ``name`` its file; a
    row without one goes to ``unnamed``. Only files that get rows are replaced. Rows of a
    file are brought together first, those of a very large one in several parts.
    """
    spark, (origin, kind) = df.sparkSession, LAYOUT[table]
    owner, file = (F.lit(c) if isinstance(c, str) else c for c in (scope, name))
    named = df.select(
        *schemas.TABLES[table].names,
        F.coalesce(F.nullif(owner, F.lit("")), F.lit("unnamed")).alias("owner_"),
        F.coalesce(F.nullif(file, F.lit("")), F.lit("unnamed")).alias("file_"),
    )
    # Written beside the layout, then every file is moved to its place.
    made = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    named.hint("rebalance", "owner_", "file_").write.partitionBy("owner_", "file_").options(
        header=True, quote='"', escape='"', timestampNTZFormat=TIMESTAMP_FORMAT
    ).csv(made)
    for path in listed(spark, f"{made}/owner_=*/file_=*"):
        folder, part = (unquote(x.partition("=")[2]) for x in path.rsplit("/", 2)[1:])
        move(spark, path, f"{root.rstrip('/')}/{origin}/{folder}/{kind}/{part}_staging.csv")
    remove(spark, made)


def staged_csv_write(df: DataFrame, root: str, table: str, scope: Column | str) -> None:
    """Write the rows of servers, one ``<job>_<kind>_staging.csv`` per job."""
    kind = LAYOUT[table][1]
    job = F.nullif(slug(F.col("job")), F.lit(""))
    staged_table_write(df, root, table, scope, F.concat(F.coalesce(job, F.lit("unnamed")), F.lit(f"_{kind}")))


def append_load(staged: DataFrame, path: str, table: str, ledger: LoadLedger | None = None) -> str:
    """Append staged rows to a stored table as one load; returns the load's id.

    Loading the same rows again changes nothing: rows already stored are left out. Only
    stored rows of the buckets that the load touches are looked at. With a ledger the load
    is entered there once it is complete, and rows of loads that never were do not count.
    """
    with intermediates(staged.sparkSession):
        load_id, _ = store_load(staged, path, table, None if ledger is None else ledger.loads(table))
    if ledger is not None:
        ledger.enter(load_id, table)
    return load_id


def store_load(staged: DataFrame, path: str, table: str, loads: list[str] | None) -> tuple[str, DataFrame]:
    """Store the staged rows that ``loads`` lack as a load that is still to be entered.

    Returns its id and the distinct staged rows from where they lie (``RowStore.take``), so
    what needs them next reads no file again.
    """
    load_id, store = new_id("load"), RowStore(staged.sparkSession, path)
    columns = [c for c in schemas.TABLES[table].names if c in staged.columns]
    return load_id, store.take(staged, columns, load_id, loads, processed=F.lit(False), ingested_at=F.current_date())


def merge_into_archive(new: DataFrame, path: str, taken: bool = False) -> None:
    """Append the rows that the archive does not hold yet; ``taken`` for those of ``store_load``."""
    RowStore(new.sparkSession, path).merge(new, new_id("load"), taken)


def staged_files(spark: SparkSession, root: str, table: str) -> list[str]:
    """The staged files of a table at this moment."""
    return listed(spark, staged_path(root, table))


def archive_staged(spark: SparkSession, paths: list[str]) -> None:
    """Take ``_staging`` off the names of these files, which are merged."""
    for path in paths:
        move(spark, path, path.removesuffix("_staging.csv") + ".csv")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Project names from a text file, one per line, blanks and quotes stripped."""
    return spark.read.text(path).select(F.trim(F.trim("value"), F.lit('"')).alias("name"))


def static_csv_import(spark: SparkSession, path: str) -> DataFrame:
    """A user's own CSV with header, types inferred, to be joined next to mined data."""
    return spark.read.options(header=True, inferSchema=True, quote='"', escape='"').csv(path)


def dataset_export(df: DataFrame, path: str, form: str = "csv") -> str:
    """Snapshot of a table for offline use, written in parallel part files."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.options(header=True, quote='"', escape='"', timestampNTZFormat=TIMESTAMP_FORMAT).csv(path)
    else:
        writer.format(form).save(path)
    return path
