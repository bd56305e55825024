"""Filters, scalar expressions, joins, aggregations, windows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..domain import Domain
from ..functions import scalars as S
from ..operators import filters, issues, quality, reports, rules
from .registry import query
from .sqltext import (
    CLOSED,
    FLOWS_SQL,
    INTRODUCED_SQL,
    OPEN,
    REMOVED_SQL,
    TOTALS_SQL,
    columns,
    metrics_union,
    pairs_union,
    strings,
)

# ------------------------------------------------------------------ scalars


@query(
    "binarize_result",
    """SELECT server, job, build_number,
              CASE WHEN result = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAIL' END AS result FROM jenkins_builds""",
    "jenkins_builds",
)
def binarize_result(d: Domain):
    return quality.label_builds(d.jenkins_builds).select("server", "job", "build_number", "result")


INTS = ["duration", "estimated_duration", "test_pass_count", "test_fail_count", "test_skip_count"]


@query(
    "cast_features_double",
    f"SELECT build_number, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in INTS)} FROM jenkins_builds",
    "jenkins_builds",
)
def cast_features_double(d: Domain):
    return filters.cast_double(d.jenkins_builds.select("build_number", *INTS), INTS)


@query(
    "drop_sparse_columns",
    """SELECT organization, project, issue_key, status, severity FROM sonar_issues""",
    "sonar_issues",
)
def drop_sparse_columns(d: Domain):
    kept = d.sonar_issues.select("organization", "project", "issue_key", "status", "severity", "close_date", "resolution")
    return filters.drop_sparse_columns(kept, ["status", "severity", "close_date", "resolution"], 0.4)


@query(
    "drop_sparse_measures",
    f"""SELECT {columns(c for c in schemas.TABLES['sonar_measures'].names if c not in schemas.SPARSE_MEASURES)} FROM sonar_measures""",
    "sonar_measures",
)
def drop_sparse_measures(d: Domain):
    """The fixed list of measures that no study uses."""
    kept = filters.drop_sparse_measures(d.sonar_measures.select(*schemas.TABLES["sonar_measures"].names))
    assert not set(schemas.SPARSE_MEASURES) & set(kept.columns)
    return kept


@query(
    "drop_bookkeeping",
    f"SELECT {columns(c for c in schemas.TABLES['sonar_analyses'].names if c != 'organization')} FROM sonar_analyses",
    "sonar_analyses",
)
def drop_bookkeeping(d: Domain):
    return filters.drop_bookkeeping(d.sonar_analyses, "organization")


@query(
    "filter_scope",
    """SELECT server, job, build_number FROM jenkins_builds
       WHERE server IN (SELECT jenkins_server FROM source WHERE batch_number = 0)""",
    "jenkins_builds source",
)
def filter_scope(d: Domain):
    servers = d.source.where(F.col("batch_number") == 0).select("jenkins_server")
    return filters.filter_scope(d.jenkins_builds, "server", servers).select("server", "job", "build_number")


@query(
    "filter_processed",
    "SELECT organization, project, analysis_key, revision FROM sonar_analyses WHERE processed = FALSE",
    "sonar_analyses",
)
def filter_processed(d: Domain):
    return filters.filter_processed(d.sonar_analyses, False).select("organization", "project", "analysis_key", "revision")


@query(
    "filter_keys_not_null",
    """SELECT analysis_key, closed_key FROM (
         SELECT analysis_key, CASE WHEN project_version = '5-LOW' THEN NULL ELSE analysis_key END AS closed_key
         FROM sonar_analyses) t WHERE closed_key IS NOT NULL""",
    "sonar_analyses",
)
def filter_keys_not_null(d: Domain):
    low = F.col("project_version").eqNullSafe("5-LOW")
    closed = F.when(~low, F.col("analysis_key"))
    keyed = d.sonar_analyses.select(closed.alias("closed_key"), closed.alias("analysis_key"))
    return filters.filter_keys(keyed, "sonar_analyses")


@query("filter_open_status", f"SELECT issue_key, status FROM sonar_issues WHERE status IN ({OPEN})", "sonar_issues")
def filter_open_status(d: Domain):
    return filters.open_issues(d.sonar_issues).select("issue_key", "status")


@query("filter_closed_status", f"SELECT issue_key, status FROM sonar_issues WHERE status IN ({CLOSED})", "sonar_issues")
def filter_closed_status(d: Domain):
    return filters.closed_issues(d.sonar_issues).select("issue_key", "status")


@query(
    "filter_project",
    "SELECT organization, project, analysis_key FROM sonar_analyses WHERE organization = 'org1' AND project = 'p7'",
    "sonar_analyses",
)
def filter_project(d: Domain):
    return filters.of_project(d.sonar_analyses, "org1", "p7").select("organization", "project", "analysis_key")


@query(
    "severity_bucket",
    "SELECT issue_key, COALESCE(severity, 'NULL_SEVERITY') AS severity FROM sonar_issues",
    "sonar_issues",
)
def severity_bucket(d: Domain):
    return d.sonar_issues.select("issue_key", S.severity_bucket(F.col("severity")).alias("severity"))


@query(
    "date_as_text",
    "SELECT analysis_key, CAST(ingested_at AS VARCHAR) AS filter_ingested_at FROM sonar_analyses",
    "sonar_analyses",
)
def date_as_text(d: Domain):
    return d.sonar_analyses.select("analysis_key", F.col("ingested_at").cast("string").alias("filter_ingested_at"))


@query(
    "slug_name",
    """SELECT server, job, regexp_replace(lower(job), '[^0-9a-z_-]', '_', 'g') AS slug FROM build_payloads""",
    "build_payloads",
)
def slug_name(d: Domain):
    return d.build_payloads.select("server", "job", S.slug(F.col("job")).alias("slug"))


@query(
    "server_host",
    "SELECT build_number, split_part(server, '/', 3) AS host FROM jenkins_builds",
    "jenkins_builds",
)
def server_host(d: Domain):
    return d.jenkins_builds.select("build_number", S.server_host(F.col("server")).alias("host"))


@query(
    "job_name_match",
    "SELECT job, event_id FROM build_payloads WHERE lower(job) LIKE '%job 1%'",
    "build_payloads",
)
def job_name_match(d: Domain):
    return d.build_payloads.where(S.name_matches(F.col("job"), "JOB 1")).select("job", "event_id")


# -------------------------------------------------------------------- joins

MEASURES = schemas.MEASURE_NUMERICS + schemas.MEASURE_CATEGORIES


@query(
    "measures_x_analyses",
    f"""SELECT a.revision, {columns(MEASURES, 'm.')} FROM sonar_measures m
        JOIN sonar_analyses a ON m.analysis_key = a.analysis_key""",
    "sonar_measures sonar_analyses",
)
def measures_x_analyses(d: Domain):
    return quality.measures_x_analyses(d.sonar_measures, d.sonar_analyses)


BUILD_FEATURES = ["job", "build_number", "result", *schemas.BUILD_NUMERICS]
ML1_JOIN = f"""FROM jenkins_builds b JOIN sonar_analyses a ON b.revision_number = a.revision
        JOIN sonar_measures m ON m.analysis_key = a.analysis_key"""


@query(
    "builds_x_measures",
    f"SELECT {columns(BUILD_FEATURES, 'b.')}, {columns(MEASURES, 'm.')} {ML1_JOIN}",
    "jenkins_builds sonar_analyses sonar_measures",
)
def builds_x_measures(d: Domain):
    return quality.builds_x_measures(d.jenkins_builds, d.sonar_measures, d.sonar_analyses).select(*BUILD_FEATURES, *MEASURES)


@query(
    "issues_x_analyses",
    f"""SELECT f.*, a.revision FROM ({FLOWS_SQL}) f JOIN sonar_analyses a ON f.analysis_key = a.analysis_key""",
    "sonar_issues sonar_analyses",
)
def issues_x_analyses(d: Domain):
    return quality.flows_x_analyses(issues.issue_flow_counts(d.sonar_issues), d.sonar_analyses)


@query(
    "builds_x_issues",
    f"""SELECT b.job, b.build_number, b.result, {columns(schemas.FLOW_FEATURES, 't.')} FROM ({TOTALS_SQL}) t
        JOIN sonar_analyses a ON t.analysis_key = a.analysis_key
        JOIN jenkins_builds b ON a.revision = b.revision_number""",
    "sonar_issues sonar_analyses jenkins_builds",
)
def builds_x_issues(d: Domain):
    totals = issues.running_issue_totals(issues.issue_flow_counts(d.sonar_issues))
    return quality.builds_x_flows(d.jenkins_builds, totals, d.sonar_analyses, ["job", "build_number"])


@query(
    "builds_semi_project",
    """SELECT server, job, build_number, revision_number FROM jenkins_builds WHERE revision_number IN
       (SELECT revision FROM sonar_analyses WHERE organization = 'org1' AND project = 'p7')""",
    "jenkins_builds sonar_analyses",
)
def builds_semi_project(d: Domain):
    analyses = filters.of_project(d.sonar_analyses, "org1", "p7")
    return quality.builds_of_projects(d.jenkins_builds, analyses).select("server", "job", "build_number", "revision_number")


# ------------------------------------------------- aggregations and windows


@query("introduced_counts", INTRODUCED_SQL, "sonar_issues")
def introduced_counts(d: Domain):
    return issues.introduced_counts(d.sonar_issues)


@query("removed_counts", REMOVED_SQL, "sonar_issues")
def removed_counts(d: Domain):
    return issues.removed_counts(d.sonar_issues)


@query("issue_flow_counts", FLOWS_SQL, "sonar_issues")
def issue_flow_counts(d: Domain):
    return issues.issue_flow_counts(d.sonar_issues)


@query("issue_flow_shared_keys", FLOWS_SQL.replace("sonar_issues", "shared_issues"), "shared_issues")
def issue_flow_shared_keys(d: Domain):
    return issues.issue_flow_counts(d.shared_issues)


@query(
    "coalesce_keys",
    f"""SELECT project, analysis_key, date FROM ({FLOWS_SQL}) f""",
    "sonar_issues",
)
def coalesce_keys(d: Domain):
    return issues.issue_flow_counts(d.sonar_issues).select("project", "analysis_key", "date")


@query(
    "coalesce_zero",
    f"""SELECT analysis_key, {columns(schemas.FLOW_COUNTS)} FROM ({FLOWS_SQL}) f""",
    "sonar_issues",
)
def coalesce_zero(d: Domain):
    return issues.issue_flow_counts(d.sonar_issues).select("analysis_key", *schemas.FLOW_COUNTS)


@query(
    "introduced_full_outer_removed",
    f"""SELECT t1.project AS introduced_project, t2.project AS removed_project,
               t1.creation_analysis_key, t2.current_analysis_key, t1.creation_date, t2.update_date
        FROM ({INTRODUCED_SQL}) t1 FULL OUTER JOIN ({REMOVED_SQL}) t2
        ON t1.creation_analysis_key = t2.current_analysis_key""",
    "sonar_issues",
)
def introduced_full_outer_removed(d: Domain):
    i = issues.introduced_counts(d.sonar_issues).withColumnRenamed("project", "introduced_project")
    r = issues.removed_counts(d.sonar_issues).withColumnRenamed("project", "removed_project")
    return i.join(r, i["creation_analysis_key"] == r["current_analysis_key"], "full_outer").select(
        "introduced_project", "removed_project", "creation_analysis_key", "current_analysis_key", "creation_date", "update_date"
    )


@query("running_issue_totals", TOTALS_SQL, "sonar_issues")
def running_issue_totals(d: Domain):
    return issues.running_issue_totals(issues.issue_flow_counts(d.sonar_issues))


RULE_EVENTS = f"""SELECT CASE WHEN status IN ({OPEN}) THEN creation_analysis_key ELSE current_analysis_key END AS analysis_key,
       CASE WHEN status IN ({OPEN}) THEN 'introduced' ELSE 'removed' END AS direction, rule
FROM sonar_issues WHERE status IN ({OPEN}, {CLOSED})"""


@query(
    "rule_counts",
    f"""SELECT analysis_key, direction, rule, COUNT(*) AS n FROM ({RULE_EVENTS}) e
        WHERE rule IS NOT NULL AND analysis_key IS NOT NULL GROUP BY analysis_key, direction, rule""",
    "sonar_issues",
)
def rule_counts(d: Domain):
    return rules.rule_counts(d.sonar_issues)


@query(
    "rule_vectors_full_outer",
    f"""SELECT COALESCE(r.current_analysis_key, i.creation_analysis_key) AS analysis_key,
               COALESCE(r.rule, i.rule) AS rule, COALESCE(removed, 0) AS removed, COALESCE(introduced, 0) AS introduced
        FROM (SELECT current_analysis_key, rule, COUNT(*) AS removed FROM sonar_issues
              WHERE status IN ({CLOSED}) GROUP BY current_analysis_key, rule) r
        FULL OUTER JOIN (SELECT creation_analysis_key, rule, COUNT(*) AS introduced FROM sonar_issues
              WHERE status IN ({OPEN}) GROUP BY creation_analysis_key, rule) i
        ON r.current_analysis_key = i.creation_analysis_key AND r.rule = i.rule""",
    "sonar_issues",
)
def rule_vectors_full_outer(d: Domain):
    return rules.rule_totals_full_outer(d.sonar_issues)


@query(
    "row_counts",
    """SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN result = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful,
              CAST(SUM(CASE WHEN result = 'SUCCESS' THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM jenkins_builds""",
    "jenkins_builds",
)
def row_counts(d: Domain):
    failed = S.fail_label(F.col("result")) == 1.0
    return d.jenkins_builds.agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed")
    )


@query("latest_build", "SELECT server, job, MAX(build_number) AS latest FROM jenkins_builds GROUP BY server, job", "jenkins_builds")
def latest_build(d: Domain):
    from ..operators.delta import latest_build as latest

    return latest(d.jenkins_builds)


# ------------------------------------------------------------------ reports

TOP_KEEP = """organization, project, model, CAST(processing_date AS VARCHAR) AS processing_date,
processing_date AS secondary_processing_date, input_data_amount"""
TOP_ISSUES_SQL = pairs_union("top_issues", TOP_KEEP, "issue", "issue_importance", "issue")
FEATURES_SQL = pairs_union("model_info", "model", "feature", "feature_importance", "feature")


@query("top_issues_unpivot", TOP_ISSUES_SQL, "top_issues")
def top_issues_unpivot(d: Domain):
    return reports.top_issues_report(d.top_issues)


@query("feature_importance_unpivot", FEATURES_SQL, "model_info")
def feature_importance_unpivot(d: Domain):
    return reports.feature_importance_report(d.model_info)


@query("train_measures_unpivot", metrics_union("model_info", "model", "train_"), "model_info")
def train_measures_unpivot(d: Domain):
    return reports.train_measures_report(d.model_info)


@query("performance_unpivot", metrics_union("model_performance", "model, processing_date"), "model_performance")
def performance_unpivot(d: Domain):
    return reports.performance_report(d.model_performance)


@query(
    "union_distinct",
    "SELECT organization, project FROM sonar_analyses UNION SELECT organization, project FROM sonar_issues",
    "sonar_analyses sonar_issues",
)
def union_distinct(d: Domain):
    return d.sonar_analyses.select("organization", "project").union(d.sonar_issues.select("organization", "project")).distinct()


@query(
    "issues_report",
    """SELECT * REPLACE (COALESCE(severity, 'NULL_SEVERITY') AS severity),
              CAST(ingested_at AS VARCHAR) AS filter_ingested_at FROM sonar_issues""",
    "sonar_issues",
)
def issues_report(d: Domain):
    return reports.issues_report(d.sonar_issues)


for _table in ("sonar_measures", "model_info", "model_performance", "jenkins_builds", "sonar_analyses"):
    query(f"plain_report_{_table}", f"SELECT * FROM {_table}", _table)(lambda d, t=_table: d.view(t))


@query("report_count", f"SELECT COUNT(*) AS count FROM ({TOP_ISSUES_SQL}) r", "top_issues")
def report_count(d: Domain):
    return reports.report_count(reports.top_issues_report(d.top_issues))


@query(
    "report_avg_importance",
    f"""SELECT organization, project, issue, ROUND(AVG(importance_value), 9) AS importance_value, COUNT(*) AS count
        FROM ({TOP_ISSUES_SQL}) r GROUP BY organization, project, issue""",
    "top_issues",
)
def report_avg_importance(d: Domain):
    report = reports.report_avg_importance(reports.top_issues_report(d.top_issues), ["organization", "project", "issue"])
    return report.withColumn("importance_value", F.round("importance_value", 9))
