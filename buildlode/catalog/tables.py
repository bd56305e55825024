"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..domain import Domain
from ..functions.scalars import server_host
from ..operators import filters
from ..session import shared_dir
from ..sources.store import RowStore
from ..sources import sinks, staging, tables
from .registry import query
from .sqltext import columns

ISSUE_COLUMNS = [c for c in schemas.TABLES["sonar_issues"].names if c != "organization"]


class _DomainTables:
    def __init__(self, d: Domain):
        self.d = d

    def table(self, name: str):
        return self.d.view(name)


@query(
    "scan_table",
    f"""SELECT {columns(ISSUE_COLUMNS)} FROM sonar_issues
        WHERE organization IN ('org0', 'org2') AND processed IS FALSE AND issue_key IS NOT NULL""",
    "sonar_issues",
)
def scan_table(d: Domain):
    return tables.scan_table(
        _DomainTables(d), "sonar_issues", processed=False, scope=["org0", "org2"], where=[F.col("issue_key").isNotNull()]
    )


@query(
    "scan_columns",
    f"SELECT {columns(c for c in schemas.TABLES['jenkins_builds'].names if c != 'server')} FROM jenkins_builds",
    "jenkins_builds",
)
def scan_columns(d: Domain):
    return tables.scan_columns(d.jenkins_builds, "jenkins_builds")


@query(
    "batch_registry",
    """SELECT b.batch_number, COALESCE(org_keys, '') AS org_keys, COALESCE(servers, '') AS servers
       FROM (SELECT CAST(UNNEST(generate_series(0, (SELECT MAX(batch_number) FROM source))) AS INT) AS batch_number) b
       LEFT JOIN (SELECT batch_number, string_agg(DISTINCT sonar_org_key, ',' ORDER BY sonar_org_key) AS org_keys,
                         string_agg(DISTINCT jenkins_server, ',' ORDER BY jenkins_server) AS servers
                  FROM source GROUP BY batch_number) s ON b.batch_number = s.batch_number""",
    "source",
)
def batch_registry(d: Domain):
    return tables.batch_registry(d.source).select(
        "batch_number", F.array_join("org_keys", ",").alias("org_keys"), F.array_join("servers", ",").alias("servers")
    )


@query(
    "distinct_sources",
    """SELECT 'organization' AS kind, sonar_org_key AS name FROM source
       UNION SELECT 'server', jenkins_server FROM source""",
    "source",
)
def distinct_sources(d: Domain):
    orgs = tables.distinct_sources(d.source, "sonar_org_key").select(F.lit("organization").alias("kind"), F.col("sonar_org_key").alias("name"))
    servers = tables.distinct_sources(d.source, "jenkins_server").select(F.lit("server"), "jenkins_server")
    return orgs.union(servers)


@query("max_batch", "SELECT MAX(batch_number) AS max_batch FROM source", "source")
def max_batch(d: Domain):
    return tables.max_batch(d.source)


@query("project_pairs", "SELECT DISTINCT organization, project FROM sonar_analyses", "sonar_analyses")
def project_pairs(d: Domain):
    return tables.project_pairs(d.sonar_analyses)


def _stage_by_org(d: Domain, table: str, root: str) -> None:
    staging.staged_table_write(d.view(table), root, table, F.col("organization"), "all")


@query(
    "staged_csv_scan",
    f"SELECT {columns(schemas.TABLES['sonar_issues'].names)} FROM sonar_issues",
    "sonar_issues",
)
def staged_csv_scan(d: Domain):
    root = shared_dir(d.spark, "staged")
    _stage_by_org(d, "sonar_issues", root)
    return staging.staged_csv_scan(d.spark, root, "sonar_issues")


# Every 13th effort is no number, every 7th debt is blank, every 17th date is no date.
_EFFORT_BAD, _DEBT_BLANK, _DATE_BAD = "effort % 13 = 5", "debt % 7 = 3", "debt % 17 = 4"


@query(
    "staged_quarantine",
    f"""SELECT issue_key, CASE WHEN {_EFFORT_BAD} OR {_DATE_BAD} THEN NULL ELSE effort END AS effort,
               CASE WHEN {_DEBT_BLANK} OR {_EFFORT_BAD} OR {_DATE_BAD} THEN NULL ELSE debt END AS debt,
               CASE WHEN {_EFFORT_BAD} AND {_DATE_BAD} THEN 'effort,update_date' WHEN {_EFFORT_BAD} THEN 'effort'
                    WHEN {_DATE_BAD} THEN 'update_date' END AS problem
        FROM sonar_issues""",
    "sonar_issues",
)
def staged_quarantine(d: Domain):
    """Rows with bad cells set aside, the others read with their NULL integers."""
    root, rejects = shared_dir(d.spark, "staged"), shared_dir(d.spark, "rejects")
    spoiled = d.sonar_issues.withColumns(
        {
            "update_date": F.expr(f"CASE WHEN {_DATE_BAD} THEN '31.12.' ELSE cast(update_date AS string) END"),
            "debt": F.expr(f"CASE WHEN {_DEBT_BLANK} THEN ' ' ELSE cast(debt AS string) END"),
            "effort": F.expr(f"CASE WHEN {_EFFORT_BAD} THEN 'n/a' ELSE cast(effort AS string) END"),
        }
    )
    staging.staged_table_write(spoiled, root, "sonar_issues", F.col("organization"), "all")
    good = staging.staged_csv_split(d.spark, staging.staged_files(d.spark, root, "sonar_issues"), "sonar_issues", rejects)
    bad = d.spark.read.parquet(f"{rejects}/sonar_issues")
    aside = bad.select(F.get_json_object("record", "$.issue_key").alias("issue_key"), F.lit(None).cast("int").alias("effort"), F.lit(None).cast("int").alias("debt"), "problem")
    return good.select("issue_key", "effort", "debt", F.lit(None).cast("string").alias("problem")).unionByName(aside)


@query(
    "staged_reject_counts",
    f"""SELECT organization AS scope_folder, CASE WHEN {_EFFORT_BAD} THEN 'effort' ELSE '' END AS problem, COUNT(*) AS n
        FROM sonar_issues GROUP BY ALL""",
    "sonar_issues",
)
def staged_reject_counts(d: Domain):
    """Counts of both sides per owner, read twice: a repeat adds no rejected row."""
    root, rejects = shared_dir(d.spark, "staged"), shared_dir(d.spark, "rejects")
    spoiled = d.sonar_issues.withColumn("effort", F.expr(f"CASE WHEN {_EFFORT_BAD} THEN 'n/a' ELSE cast(effort AS string) END"))
    staging.staged_table_write(spoiled, root, "sonar_issues", F.col("organization"), "all")
    files = staging.staged_files(d.spark, root, "sonar_issues")
    for _ in range(2):
        good = staging.staged_csv_split(d.spark, files, "sonar_issues", rejects)
    kept = good.groupBy("staged_file").agg(F.lit("").alias("problem"), F.count("*").alias("n"))
    owner = F.regexp_extract("staged_file", "/sonarcloud/([^/]+)/issues/", 1).alias("scope_folder")
    both = kept.unionByName(staging.reject_counts(d.spark, rejects, "sonar_issues"))
    return both.groupBy(owner, "problem").agg(F.sum("n").alias("n"))


@query(
    "staged_layout_scan",
    """SELECT 'sonar_analyses' AS table_name, organization AS scope_folder, COUNT(*) AS row_count
       FROM sonar_analyses GROUP BY organization
       UNION ALL SELECT 'sonar_issues', organization, COUNT(*) FROM sonar_issues GROUP BY organization
       UNION ALL SELECT 'jenkins_builds', split_part(server, '/', 3), COUNT(*) FROM jenkins_builds GROUP BY server""",
    "sonar_analyses sonar_issues jenkins_builds",
)
def staged_layout_scan(d: Domain):
    root = shared_dir(d.spark, "layout")
    _stage_by_org(d, "sonar_analyses", root)
    _stage_by_org(d, "sonar_issues", root)
    _stage_builds(d, root)
    parts = [
        df.groupBy("scope_folder").agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "*")
        for t, df in staging.staged_layout_scan(d.spark, root).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stage_builds(d: Domain, root: str) -> None:
    staging.staged_csv_write(d.jenkins_builds, root, "jenkins_builds", server_host(F.col("server")))


@query(
    "staged_csv_write",
    f"""SELECT {columns(schemas.TABLES['jenkins_builds'].names)}, split_part(server, '/', 3) AS scope_folder
        FROM jenkins_builds""",
    "jenkins_builds",
)
def staged_csv_write(d: Domain):
    root = shared_dir(d.spark, "builds")
    _stage_builds(d, root)
    return staging.staged_layout_scan(d.spark, root)["jenkins_builds"]


@query(
    "append_load",
    f"""SELECT {columns(schemas.TABLES['sonar_analyses'].names)}, FALSE AS processed FROM sonar_analyses""",
    "sonar_analyses",
)
def append_load(d: Domain):
    path = shared_dir(d.spark, "loaded")
    staging.append_load(d.sonar_analyses, path, "sonar_analyses")
    staging.append_load(d.sonar_analyses, path, "sonar_analyses")
    return RowStore(d.spark, path).rows().drop("ingested_at")


@query(
    "result_rows",
    """SELECT model, CAST(COUNT(*) AS INT) AS data_amount,
              ROUND(AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy
       FROM predictions GROUP BY model""",
    "predictions",
)
def result_rows(d: Domain):
    hit = (F.col("label") == F.col("prediction")).cast("double")
    measured = d.predictions.groupBy("model").agg(F.count("*").cast("int").alias("data_amount"), F.round(F.avg(hit), 9).alias("accuracy"))
    rows = [r.asDict() for r in measured.collect()]
    return sinks.result_rows(d.spark, "model_performance", rows).select("model", "data_amount", "accuracy")


@query(
    "result_sink",
    f"""SELECT {columns(schemas.MODEL_PERFORMANCE.names)} FROM model_performance
        UNION ALL SELECT {columns(schemas.MODEL_PERFORMANCE.names)} FROM model_performance""",
    "model_performance",
)
def result_sink(d: Domain):
    results = sinks.ParquetResults(d.spark, shared_dir(d.spark, "results"))
    results.append("model_performance", d.model_performance)
    results.append("model_performance", d.model_performance)
    return results.table("model_performance").drop("processing_date")


@query(
    "sql_view",
    """SELECT project, status, COUNT(*) AS issue_count, MAX(update_date) AS last_update
       FROM sonar_issues GROUP BY project, status""",
    "sonar_issues",
)
def sql_view(d: Domain):
    text = """SELECT project, status, COUNT(*) AS issue_count, MAX(update_date) AS last_update
              FROM {sonar_issues} GROUP BY project, status"""
    return tables.sql_view(d.spark, text, sonar_issues=d.sonar_issues)


@query("dataset_export", "SELECT * FROM sonar_analyses", "sonar_analyses")
def dataset_export(d: Domain):
    path = staging.dataset_export(d.sonar_analyses, shared_dir(d.spark, "export"))
    return (
        d.spark.read.options(header=True, quote='"', escape='"', timestampNTZFormat=staging.TIMESTAMP_FORMAT)
        .schema(d.sonar_analyses.schema)
        .csv(path)
    )


@query("static_csv_import", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def static_csv_import(d: Domain):
    path = staging.dataset_export(d.base("part"), shared_dir(d.spark, "static"))
    imported = staging.static_csv_import(d.spark, path)
    return imported.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query(
    "name_list_source",
    """SELECT job, build_number, server FROM jenkins_builds
       WHERE job IN (SELECT concat('job', CAST(n_nationkey AS VARCHAR)) FROM nation)""",
    "jenkins_builds",
)
def name_list_source(d: Domain):
    path = shared_dir(d.spark, "names")
    lines = d.base("nation").select(F.concat(F.lit(' "job'), F.col("n_nationkey").cast("string"), F.lit('" ')).alias("value"))
    lines.write.text(path)
    names = staging.name_list(d.spark, path)
    return filters.filter_scope(d.jenkins_builds, "job", names).select("job", "build_number", "server")
