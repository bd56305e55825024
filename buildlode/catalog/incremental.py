"""Deltas, merges, stamping and the streaming jobs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import schemas
from ..domain import Domain
from ..operators import delta, issues, quality
from ..functions.scalars import server_host
from ..plans import cycle, jobs
from ..session import at_once, cut_lineage, shared_dir
from ..sources import staging
from ..sources.balances import BalanceStore
from ..sources.ledger import LedgerTables, LoadLedger, new_id
from ..sources.marks import MarkTable
from ..sources.sinks import Artefacts, ParquetResults
from ..sources.store import RowStore
from ..streaming import ingest
from .registry import query
from .relational import BUILD_FEATURES, MEASURES, ML1_JOIN
from .sqltext import CLOSED, FLOWS_SQL, OPEN, TOTALS_SQL, columns
from .tables import _stage_by_org

FAILED = "CASE WHEN b.result = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAIL' END AS result"
DELTA_COLUMNS = ["job", "build_number", *schemas.BUILD_NUMERICS]


@query(
    "incremental_delta",
    f"""SELECT {columns(DELTA_COLUMNS, 'b.')}, {FAILED}, {columns(MEASURES, 'm.')} {ML1_JOIN}
        WHERE b.processed = FALSE OR a.processed = FALSE OR m.processed = FALSE""",
    "jenkins_builds sonar_analyses sonar_measures",
)
def incremental_delta(d: Domain):
    out = delta.incremental_delta(d.jenkins_builds, d.sonar_measures, d.sonar_analyses)
    return out.select(*DELTA_COLUMNS, "result", *MEASURES)


@query(
    "union_batches",
    f"""SELECT sb.batch_number, {columns(BUILD_FEATURES, 'b.')}, {columns(MEASURES, 'm.')}
        FROM (SELECT DISTINCT batch_number, jenkins_server FROM source) sb
        JOIN jenkins_builds b ON b.server = sb.jenkins_server
        JOIN sonar_analyses a ON a.revision = b.revision_number
        JOIN (SELECT DISTINCT batch_number, sonar_org_key FROM source) sa
          ON sa.sonar_org_key = a.organization AND sa.batch_number = sb.batch_number
        JOIN sonar_measures m ON m.analysis_key = a.analysis_key
        JOIN (SELECT DISTINCT batch_number, sonar_org_key FROM source) sm
          ON sm.sonar_org_key = m.organization AND sm.batch_number = sb.batch_number""",
    "source jenkins_builds sonar_analyses sonar_measures",
)
def union_batches(d: Domain):
    out = quality.union_batches(d.jenkins_builds, d.sonar_measures, d.sonar_analyses, d.source)
    return out.select("batch_number", *BUILD_FEATURES, *MEASURES)


ANALYSIS_COLUMNS = schemas.TABLES["sonar_analyses"].names


@query(
    "merge_dedup",
    f"""SELECT {columns(ANALYSIS_COLUMNS)} FROM sonar_analyses WHERE processed
        UNION SELECT {columns(ANALYSIS_COLUMNS)} FROM sonar_analyses""",
    "sonar_analyses",
)
def merge_dedup(d: Domain):
    """An archive that was stored with copies, then a load in which some rows are known."""
    everything = d.sonar_analyses.select(*ANALYSIS_COLUMNS)
    known = d.sonar_analyses.where("processed").select(*ANALYSIS_COLUMNS)
    archive = RowStore(d.spark, shared_dir(d.spark, "archive"))
    archive.merge(known.unionAll(known), "load-1")
    archive.merge(everything, "load-2")
    return archive.rows()


@query(
    "merge_dedup_frames",
    f"""SELECT {columns(ANALYSIS_COLUMNS)} FROM sonar_analyses WHERE processed
        UNION SELECT {columns(ANALYSIS_COLUMNS)} FROM sonar_analyses""",
    "sonar_analyses",
)
def merge_dedup_frames(d: Domain):
    everything = d.sonar_analyses.select(*ANALYSIS_COLUMNS)
    return delta.merge_dedup(everything, d.sonar_analyses.where("processed").select(*ANALYSIS_COLUMNS))


@query(
    "unprocessed_delta",
    "SELECT server, job, build_number, revision_number FROM jenkins_builds WHERE processed = FALSE",
    "jenkins_builds",
)
def unprocessed_delta(d: Domain):
    return delta.unprocessed(d.jenkins_builds).select("server", "job", "build_number", "revision_number")


@query(
    "stamp_processed",
    """SELECT organization, project, analysis_key, ingested_at,
              CASE WHEN ingested_at <= DATE '1999-06-30' THEN TRUE ELSE processed END AS processed
       FROM sonar_analyses""",
    "sonar_analyses",
)
def stamp_processed(d: Domain):
    stamped = delta.stamp_processed(d.sonar_analyses, F.lit("1999-06-30").cast("date"))
    return stamped.select("organization", "project", "analysis_key", "ingested_at", "processed")


@query(
    "stamp_by_ledger",
    """SELECT organization, project, analysis_key, ingested_at,
              CASE WHEN ingested_at <= DATE '1999-06-30' THEN TRUE ELSE processed END AS processed
       FROM sonar_analyses""",
    "sonar_analyses",
)
def stamp_by_ledger(d: Domain):
    """Three loads, two runs: the last load arrives while the second run is under way."""
    root, table = shared_dir(d.spark, "tables"), "sonar_analyses"
    ledger, store = LoadLedger(d.spark, root), RowStore(d.spark, f"{root}/{table}")

    def load(rows):
        load_id = new_id("load")
        store.add(store.unstored(rows, [*ANALYSIS_COLUMNS, "ingested_at"]), load_id, processed=F.lit(False))
        ledger.enter(load_id, table)

    early = F.col("ingested_at") <= F.lit("1999-06-30").cast("date")
    load(d.sonar_analyses.where("processed"))
    ledger.finish(ledger.begin())
    load(d.sonar_analyses.where(~F.col("processed") & early))
    run = ledger.begin()
    load(d.sonar_analyses.where(~F.col("processed") & ~early))
    ledger.finish(run)
    stored = LedgerTables(ledger).table(table)
    return stored.select("organization", "project", "analysis_key", "ingested_at", "processed")


@query(
    "high_water_mark",
    """SELECT b.server, b.job, b.build_number FROM jenkins_builds b
       LEFT JOIN (SELECT server, job, MAX(build_number) AS latest FROM jenkins_builds
                  WHERE ingested_at <= DATE '2024-01-10' GROUP BY server, job) s ON b.server = s.server AND b.job = s.job
       WHERE b.build_number > COALESCE(latest, -1)""",
    "jenkins_builds",
)
def high_water_mark(d: Domain):
    stored = d.jenkins_builds.where(F.col("ingested_at") <= F.lit("2024-01-10").cast("date"))
    return delta.above_high_water_mark(d.jenkins_builds, stored).select("server", "job", "build_number")


@query(
    "high_water_marks",
    """SELECT b.server, b.job, b.build_number FROM jenkins_builds b
       LEFT JOIN (SELECT server, job, MAX(build_number) AS latest FROM jenkins_builds
                  WHERE ingested_at <= DATE '2024-01-10' GROUP BY server, job) s ON b.server = s.server AND b.job = s.job
       WHERE b.build_number > COALESCE(latest, -1)""",
    "jenkins_builds",
)
def high_water_marks(d: Domain):
    """The mark table after three loads, one of them repeated, with a merge of its folders."""
    marks = MarkTable(d.spark, shared_dir(d.spark, "marks"))
    stored = d.jenkins_builds.where(F.col("ingested_at") <= F.lit("2024-01-10").cast("date"))
    for load in (2, 0, 1, 0):
        marks.merge(stored.where(F.col("build_number") % 3 == load), f"load-{load}", folders=2)
    return marks.new_builds(d.jenkins_builds).select("server", "job", "build_number")


@query(
    "stream_staged_ingest",
    f"SELECT DISTINCT {columns(ANALYSIS_COLUMNS)}, FALSE AS processed FROM sonar_analyses",
    "sonar_analyses",
)
def stream_staged_ingest(d: Domain):
    root, path, state = (shared_dir(d.spark, n) for n in ("stage", "table", "state"))
    _stage_by_org(d, "sonar_analyses", root)
    for _ in range(2):  # the second run finds no new file
        ingest.stream_staged_ingest(d.spark, root, "sonar_analyses", path, state).awaitTermination()
    return RowStore(d.spark, path).rows().drop("ingested_at")


@query(
    "stream_merge_dedup",
    f"SELECT DISTINCT {columns(ANALYSIS_COLUMNS)} FROM sonar_analyses",
    "sonar_analyses",
)
def stream_merge_dedup(d: Domain):
    root, path, state = (shared_dir(d.spark, n) for n in ("stage", "archive", "state"))
    _stage_by_org(d, "sonar_analyses", root)
    # The archive already holds the processed rows; the stream brings all rows.
    known = d.sonar_analyses.where("processed").select(*ANALYSIS_COLUMNS)
    RowStore(d.spark, path).merge(known, "load-1")
    ingest.stream_merge_dedup(ingest.staged_stream(d.spark, root, "sonar_analyses"), path, state).awaitTermination()
    return RowStore(d.spark, path).rows()


@query(
    "stream_issue_counts",
    f"""SELECT project, CASE WHEN status IN ({OPEN}) THEN creation_analysis_key ELSE current_analysis_key END AS analysis_key,
        CASE WHEN status IN ({OPEN}) THEN 'introduced' ELSE 'removed' END AS direction, type, severity, COUNT(*) AS n
        FROM sonar_issues WHERE status IN ({OPEN}, {CLOSED}) GROUP BY ALL""",
    "sonar_issues",
)
def stream_issue_counts(d: Domain):
    root, path, state = (shared_dir(d.spark, n) for n in ("stage", "counts", "state"))
    _stage_by_org(d, "sonar_issues", root)
    stream = ingest.staged_stream(d.spark, root, "sonar_issues")
    ingest.stream_issue_counts(stream, path, state).awaitTermination()
    return ingest.latest_counts(d.spark, path).drop("date")


@query(
    "stream_wide_counts",
    f"""SELECT project, analysis_key, {columns(schemas.FLOW_COUNTS)} FROM ({FLOWS_SQL}) f""",
    "sonar_issues",
)
def stream_wide_counts(d: Domain):
    root, path, state = (shared_dir(d.spark, n) for n in ("stage", "counts", "state"))
    _stage_by_org(d, "sonar_issues", root)
    stream = ingest.staged_stream(d.spark, root, "sonar_issues")
    ingest.stream_issue_counts(stream, path, state).awaitTermination()
    return ingest.wide_counts(d.spark, path)


@query("stream_issue_flows", FLOWS_SQL, "sonar_issues")
def stream_issue_flows(d: Domain):
    """Flows with their dates from a stream of many batches that merges its own state."""
    root, path, state = (shared_dir(d.spark, n) for n in ("stage", "counts", "state"))
    parts = d.sonar_issues.withColumn("part", F.concat(F.lit("part"), F.crc32("issue_key") % 4))
    staging.staged_table_write(parts, root, "sonar_issues", "org", F.col("part"))
    stream = ingest.staged_stream(d.spark, root, "sonar_issues", files_per_batch=1)
    ingest.stream_issue_counts(stream, path, state, compact_every=2).awaitTermination()
    return ingest.streamed_flows(d.spark, path)


# Flows of which some have no date.
_DATED = f"""SELECT project, analysis_key, CASE WHEN cast(substr(analysis_key, 2) AS bigint) % 41 = 0 THEN NULL ELSE date END AS date,
    {columns(schemas.FLOW_COUNTS)} FROM ({FLOWS_SQL}) g"""


@query("running_totals_by_steps", TOTALS_SQL.replace(FLOWS_SQL, _DATED), "sonar_issues")
def running_totals_by_steps(d: Domain):
    """Totals after four steps with late rows, dates that are missing and corrected dates.

    The first step takes a third of the flows and another third with wrong dates, the
    second the last third, the third takes the wrong rows back; the fourth is a repeat.
    """
    flows = issues.issue_flow_counts(d.sonar_issues)
    number = F.substring("analysis_key", 2, 20).cast("bigint")
    flows = cut_lineage(flows.withColumn("date", F.when(number % 41 != 0, F.col("date"))), "flows")
    part = lambda n: flows.where(number % 3 == n)
    wrong = part(2).withColumn("date", F.when(number % 5 != 0, F.expr("date + INTERVAL '40' DAY")))
    store = BalanceStore(d.spark, shared_dir(d.spark, "balances"))
    store.step(part(0).unionAll(wrong), 0)
    store.step(part(1), 1)
    signed = lambda rows, sign: rows.withColumn("sign", F.lit(sign))
    for _ in range(2):
        store.step(signed(wrong, -1).unionAll(signed(part(2), 1)), 2)
    return store.running_issue_totals(flows)


# Rows that a cycle finds staged; the others arrive while its models run.
EARLY = {
    "sonar_analyses": "project NOT IN ('p7', 'p8')",
    "sonar_measures": "project NOT IN ('p7', 'p8')",
    "sonar_issues": "project NOT IN ('p7', 'p8')",
    "jenkins_builds": "job NOT IN ('job7', 'job8')",
}


def _cycle_sql() -> str:
    parts = []
    for table, early in EARLY.items():
        rows = f"(SELECT DISTINCT {columns(schemas.TABLES[table].names)} FROM {table}) t"
        parts += [
            f"SELECT 1 AS run, '{table}' AS table_name, COUNT(*) AS new_rows, COUNT(*) AS all_rows FROM {rows} WHERE {early}",
            f"SELECT 2, '{table}', COUNT(*) FILTER (WHERE NOT ({early})), COUNT(*) FROM {rows}",
            f"SELECT 3, '{table}', 0, COUNT(*) FROM {rows}",
        ]
    # Three classifiers on all and on the ten best features; nothing new gives no report.
    parts += ["SELECT 1, 'model_performance', 6, 6", "SELECT 2, 'model_performance', 6, 12", "SELECT 3, 'model_performance', 0, 12"]
    return " UNION ALL ".join(parts)


@query("run_cycle", _cycle_sql(), "sonar_analyses sonar_measures sonar_issues jenkins_builds")
def run_cycle(d: Domain):
    """Three cycles over all four tables with the quality study.

    While the models of the first one run, the rest of the analyses and issues is staged
    and the rest of the measures and builds is loaded: both are new to the second cycle.
    The third, with all analyses and builds staged once more, finds nothing new.
    """
    spark = d.spark
    staged, root, archive, models, results = (shared_dir(spark, n) for n in ("stage", "tables", "archive", "models", "results"))
    d.source.write.parquet(f"{root}/source")
    ledger = LoadLedger(spark, root)

    def stage(table: str, where: str, name: str) -> None:
        scope = server_host(F.col("server")) if table == "jenkins_builds" else F.col("organization")
        staging.staged_table_write(d.view(table).where(where), staged, table, scope, name)

    def load(table: str, where: str) -> None:
        staging.append_load(d.view(table).where(where), f"{root}/{table}", table, ledger)

    def study(run: int):
        def go(tables):
            rows = [(run, t, *tables.table(t).agg(F.count_if(~F.col("processed")), F.count("*")).first()) for t in EARLY]
            if run == 1:
                late = {t: f"NOT ({EARLY[t]})" for t in EARLY}
                staged_late = [partial(stage, t, late[t], "late") for t in ("sonar_analyses", "sonar_issues")]
                loaded = [partial(load, t, late[t]) for t in ("sonar_measures", "jenkins_builds")]
                at_once(spark, *staged_late, *loaded)
            job = jobs.Study(spark, tables, Artefacts(spark, models), ParquetResults(spark, results))
            report = jobs.job_ml1(job, "first" if run == 1 else "incremental")
            made = 0 if report is None else report.count()
            return [*rows, (run, "model_performance", made, job.results.table("model_performance").count())]

        return go

    rows = []
    for run in (1, 2, 3):
        staged_now = {1: list(EARLY), 3: ["sonar_analyses", "jenkins_builds"]}.get(run, ())
        at_once(spark, *[partial(stage, t, EARLY[t] if run == 1 else "TRUE", f"early{run}") for t in staged_now])
        rows += cycle.run_cycle(spark, staged, root, archive, study(run), list(EARLY))
    return spark.createDataFrame(rows, "run int, table_name string, new_rows bigint, all_rows bigint")
