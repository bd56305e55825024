"""Landed CI payloads. The check SQL reads the columns the payload text was made of,
so it does not depend on a second JSON reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import Domain
from ..functions import scalars as S
from ..operators import landed
from .registry import ORACLES, query

SERVER = "concat('https://ci', CAST(user_id % 3 AS VARCHAR), '.example.com/')"
JOB = "concat('Folder/Job ', CAST(user_id % 20 AS VARCHAR))"
PASSED = """CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 97 AS INT)
    WHEN event_id % 4 = 1 THEN CAST(event_id % 97 + 10 - event_id % 5 - event_id % 3 AS INT) END"""
DURATION = """CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 8 < 4 THEN CAST(event_id % 100 AS DOUBLE) + 0.25
    ELSE CAST(event_id % 100 AS DOUBLE) + 0.5 END"""
SECOND = "CAST(substr(CAST(ts AS VARCHAR), 1, 19) AS TIMESTAMP)"
COMMITS = f"""(
  SELECT event_id AS e, CAST(NULL AS VARCHAR) AS commit_id, CAST(NULL AS TIMESTAMP) AS commit_ts FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, concat('c', CAST(event_id AS VARCHAR)), {SECOND} - INTERVAL 330 MINUTE FROM events WHERE event_id % 3 > 0
  UNION ALL SELECT event_id, concat('d', CAST(event_id AS VARCHAR)), {SECOND} FROM events WHERE event_id % 3 = 2)"""


@query(
    "flatten_builds",
    f"""SELECT {SERVER} AS server, {JOB} AS job, CAST(event_id AS INT) AS build_number,
        CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN NULL ELSE 'SUCCESS' END AS result,
        CAST(floor(value * 1000) AS BIGINT) AS duration, CAST(floor(value * 900) AS BIGINT) AS estimated_duration,
        concat('rev', CAST(event_id AS VARCHAR)) AS revision_number, commit_id, commit_ts,
        {PASSED} AS test_pass_count, CAST(event_id % 5 AS INT) AS test_fail_count,
        CAST(event_id % 3 AS INT) AS test_skip_count, {DURATION} AS total_test_duration
        FROM events JOIN {COMMITS} c ON e = event_id""",
)
def flatten_builds(d: Domain):
    return landed.flatten_builds(d.build_payloads)


@query(
    "explode_commits",
    f"SELECT CAST(e AS BIGINT) AS build_number, commit_id, commit_ts FROM {COMMITS} c",
)
def explode_commits(d: Domain):
    facts = landed.build_facts(landed.parse_payloads(d.build_payloads))
    return landed.explode_commits(facts).select("build_number", "commit_id", "commit_ts")


@query(
    "explode_commits_last_only",
    f"""SELECT event_id AS build_number,
        CASE WHEN event_id % 3 = 1 THEN concat('c', CAST(event_id AS VARCHAR))
             WHEN event_id % 3 = 2 THEN concat('d', CAST(event_id AS VARCHAR)) END AS commit_id FROM events""",
)
def explode_commits_last_only(d: Domain):
    facts = landed.build_facts(landed.parse_payloads(d.build_payloads))
    return landed.explode_commits(facts, last_only=True).select("build_number", "commit_id")


@query(
    "parse_commit_ts",
    f"""SELECT event_id, {SECOND} - INTERVAL 330 MINUTE AS east, {SECOND} + INTERVAL 90 MINUTE AS west,
        {SECOND} AS iso, CAST(NULL AS TIMESTAMP) AS missing FROM events""",
)
def parse_commit_ts(d: Domain):
    second = F.substring(F.col("ts").cast("string"), 1, 19)
    iso = F.concat(F.translate(second, " ", "T"), F.lit(".000Z"))
    return d.base("events").select(
        "event_id",
        S.commit_timestamp(F.concat(second, F.lit(" +0530"))).alias("east"),
        S.commit_timestamp(F.concat(second, F.lit(" -0130"))).alias("west"),
        S.commit_timestamp(iso).alias("iso"),
        S.commit_timestamp(F.lit(None).cast("string")).alias("missing"),
    )


SUITE_NAME = "concat('org.acme.m', CAST(event_id % 9 AS VARCHAR))"
CASES = """(SELECT event_id AS e, concat('case_', CAST(event_id % 17 AS VARCHAR)) AS name,
       CAST(event_id % 30 AS DOUBLE) + 0.5 AS duration, 'PASSED' AS status FROM events
  UNION ALL SELECT event_id, 'plain', 0.25, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'PASSED' END FROM events)"""
COPIES = "(SELECT 1 AS copy UNION ALL SELECT 2)"


@query(
    "flatten_tests",
    f"""SELECT {JOB} AS job, event_id AS build_number, {SUITE_NAME} AS package,
        concat('T', CAST(user_id % 13 AS VARCHAR)) AS class, name, duration, status
        FROM events JOIN {CASES} c ON e = event_id
        JOIN {COPIES} k ON event_id % 4 <> 3 AND (copy = 1 OR event_id % 8 >= 4)""",
)
def flatten_tests(d: Domain):
    return landed.flatten_tests(d.build_payloads)


@query(
    "clean_case_name",
    f"""SELECT event_id AS build_number, name FROM events JOIN {CASES} c ON e = event_id
        JOIN {COPIES} k ON event_id % 4 <> 3 AND (copy = 1 OR event_id % 8 >= 4)""",
)
def clean_case_name(d: Domain):
    return landed.flatten_tests(d.build_payloads).select("build_number", "name")


@query(
    "split_package_class",
    """SELECT p_partkey, 'pkg.' || p_type AS package, p_brand AS class, '' AS bare_package, p_type AS bare_class FROM part""",
)
def split_package_class(d: Domain):
    suite = F.concat(F.lit("pkg."), F.col("p_type"), F.lit("."), F.col("p_brand"))
    return d.base("part").select(
        "p_partkey",
        S.package_of(suite).alias("package"),
        S.class_tail(suite).alias("class"),
        S.package_of(F.col("p_type")).alias("bare_package"),
        S.class_tail(F.col("p_type")).alias("bare_class"),
    )


@query(
    "class_tail",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 8 < 4 THEN 'TestResult'
       ELSE 'SurefireAggregatedReport' END AS report_kind FROM events""",
)
def class_tail(d: Domain):
    return landed.parse_payloads(d.build_payloads).select("event_id", S.class_tail(F.col("tests._class")).alias("report_kind"))


@query("derive_pass_count", f"SELECT event_id AS build_number, {PASSED} AS test_pass_count FROM events")
def derive_pass_count(d: Domain):
    return landed.numbered(landed.build_facts(landed.parse_payloads(d.build_payloads))).select("build_number", "test_pass_count")


@query(
    "build_number_fallback",
    "SELECT event_id, event_id AS build_number FROM events",
)
def build_number_fallback(d: Domain):
    return landed.numbered(landed.build_facts(landed.parse_payloads(d.build_payloads))).select("event_id", "build_number")


@query(
    "extract_revision",
    "SELECT event_id, concat('rev', CAST(event_id AS VARCHAR)) AS revision_number FROM events",
)
def extract_revision(d: Domain):
    return landed.parse_payloads(d.build_payloads).select("event_id", landed.revision().alias("revision_number"))


@query("suite_duration_sum", f"SELECT event_id, {DURATION} AS total_test_duration FROM events")
def suite_duration_sum(d: Domain):
    return landed.parse_payloads(d.build_payloads).select("event_id", landed.suite_duration().alias("total_test_duration"))


TREE = """SELECT concat('Solo/', c_name) AS job, 'FreeStyleProject' AS kind, FALSE AS is_folder FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT concat('Team/', c_mktsegment, '/', c_name), 'FreeStyleProject', FALSE FROM customer WHERE c_custkey % 3 > 0
    UNION ALL SELECT concat('Other/', c_name), 'OrganizationFolder', TRUE FROM customer WHERE c_custkey % 3 > 0"""


@query("flatten_job_tree", TREE)
def flatten_job_tree(d: Domain):
    return landed.flatten_job_tree(d.job_nodes)


@query("exclude_folders", f"SELECT job, kind FROM ({TREE}) t WHERE NOT is_folder")
def exclude_folders(d: Domain):
    return landed.exclude_folders(landed.flatten_job_tree(d.job_nodes)).select("job", "kind")


DEEP_TREE = """WITH RECURSIVE c AS (
      SELECT c_custkey, c_name, concat('area', c_custkey % 5) AS area, concat('area', c_custkey % 5, '/t', c_custkey % 4) AS team,
             concat('area', c_custkey % 5, '/t', c_custkey % 4, '/g', c_custkey % 3) AS grp FROM customer
    ), listed AS (
      SELECT area AS parent, team AS job, 'OrganizationFolder' AS kind FROM c
      UNION SELECT team, grp, 'Folder' FROM c
      UNION SELECT team, concat(team, '/lost'), 'Folder' FROM c
      UNION SELECT grp, concat(grp, '/', c_name), 'FreeStyleProject' FROM c
      UNION SELECT grp, concat(grp, '/deep'), 'WorkflowMultiBranchProject' FROM c WHERE c_custkey % 7 = 0
      UNION SELECT concat(grp, '/deep'), concat(grp, '/deep/b', c_custkey), 'WorkflowJob' FROM c WHERE c_custkey % 7 = 0
      UNION SELECT concat(grp, '/deep'), area, 'Folder' FROM c WHERE c_custkey % 7 = 0
    ), landed AS (
      SELECT area AS job, 'Folder' AS kind FROM c UNION SELECT team, 'Folder' FROM c UNION SELECT grp, 'Folder' FROM c
      UNION SELECT concat(grp, '/deep'), 'WorkflowMultiBranchProject' FROM c WHERE c_custkey % 7 = 0
      UNION SELECT concat('Solo/', c_name), 'FreeStyleProject' FROM c WHERE c_custkey % 11 = 0
    ), tree AS (
      SELECT job, kind, 0 AS level, [job] AS path FROM landed WHERE job NOT IN ({roots})
      UNION ALL
      SELECT l.job, l.kind, t.level + 1, list_append(t.path, l.job) FROM tree t JOIN listed l ON l.parent = t.job
      WHERE NOT list_contains(t.path, l.job)
    )
    SELECT job, kind, kind IN ('Folder', 'OrganizationFolder', 'WorkflowMultiBranchProject') AS is_folder,
           job IN (SELECT job FROM landed) AS is_landed, MIN(level) AS level FROM tree GROUP BY job, kind"""


@query("job_tree", DEEP_TREE.replace("NOT IN ({roots})", "IN (SELECT area FROM c) OR job LIKE 'Solo/%'"), "job_tree_nodes")
def job_tree(d: Domain):
    """Areas are named as roots, as deep folders list them again."""
    roots = d.base("customer").select(F.concat(F.lit("area"), (F.col("c_custkey") % 5).cast("string")).alias("job"))
    solo = d.base("customer").select(F.concat(F.lit("Solo/"), "c_name"))
    return landed.job_tree(d.job_tree_nodes, roots.union(solo))


ORACLES["job_tree"] = ORACLES["job_tree"][ORACLES["job_tree"].index("WITH RECURSIVE") :]
