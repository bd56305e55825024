"""Table schemas, column lists and value domains of the study tables.

Every list under a "Fixed values" comment is part of the data contract: the
names, the order and the types have to stay as they are for stored tables and
saved models to remain usable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Status, type and severity domains of an issue.
OPEN_STATUSES = ["OPEN", "REOPENED", "CONFIRMED", "TO_REVIEW"]
CLOSED_STATUSES = ["RESOLVED", "CLOSED", "REVIEWED"]
ISSUE_TYPES = ["CODE_SMELL", "BUG", "VULNERABILITY", "SECURITY_HOTSPOT"]
SEVERITIES = ["BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO", None]
NULL_SEVERITY_LABEL = "NULL_SEVERITY"

# Build outcome labels and the folder kinds of a CI job tree.
SUCCESS, FAIL = "SUCCESS", "FAIL"
FOLDER_KINDS = ["Folder", "OrganizationFolder", "WorkflowMultiBranchProject"]
AGGREGATED_REPORT_KINDS = ["SurefireAggregatedReport", "MatrixTestResult"]
PLAIN_REPORT_KIND = "TestResult"

# --------------------------------------------------------------------------
# Table columns and types, in stored order.
SOURCE_DDL = """
    id INT, sonar_org_key STRING, jenkins_server STRING, batch_number INT,
    input_date DATE
"""

JENKINS_BUILDS_DDL = """
    server STRING, job STRING, build_number INT, result STRING,
    duration BIGINT, estimated_duration BIGINT, revision_number STRING,
    commit_id STRING, commit_ts TIMESTAMP_NTZ, test_pass_count INT,
    test_fail_count INT, test_skip_count INT, total_test_duration DOUBLE
"""

JENKINS_TESTS_DDL = """
    job STRING, build_number BIGINT, package STRING, class STRING,
    name STRING, duration DOUBLE, status STRING
"""

SONAR_ANALYSES_DDL = """
    organization STRING, project STRING, analysis_key STRING,
    date TIMESTAMP_NTZ, project_version STRING, revision STRING
"""

SONAR_ISSUES_DDL = """
    organization STRING, project STRING, current_analysis_key STRING,
    creation_analysis_key STRING, issue_key STRING, type STRING, rule STRING,
    severity STRING, status STRING, resolution STRING, effort INT, debt INT,
    tags STRING, creation_date TIMESTAMP_NTZ, update_date TIMESTAMP_NTZ,
    close_date TIMESTAMP_NTZ
"""

SONAR_MEASURES_DDL = """
    organization STRING, project STRING, analysis_key STRING,
    complexity INT, class_complexity DOUBLE, function_complexity DOUBLE,
    file_complexity DOUBLE, function_complexity_distribution STRING,
    file_complexity_distribution STRING, complexity_in_classes INT,
    complexity_in_functions INT, cognitive_complexity INT, test_errors INT,
    skipped_tests INT, test_failures INT, tests INT, test_execution_time INT,
    test_success_density DOUBLE, coverage DOUBLE, lines_to_cover INT,
    uncovered_lines INT, line_coverage DOUBLE, conditions_to_cover INT,
    uncovered_conditions INT, branch_coverage DOUBLE, new_coverage DOUBLE,
    new_lines_to_cover INT, new_uncovered_lines INT, new_line_coverage DOUBLE,
    new_conditions_to_cover INT, new_uncovered_conditions INT,
    new_branch_coverage DOUBLE, executable_lines_data STRING, public_api INT,
    public_documented_api_density DOUBLE, public_undocumented_api INT,
    duplicated_lines INT, duplicated_lines_density DOUBLE,
    duplicated_blocks INT, duplicated_files INT, duplications_data STRING,
    new_duplicated_lines INT, new_duplicated_blocks INT,
    new_duplicated_lines_density DOUBLE, quality_profiles STRING,
    quality_gate_details STRING, violations INT, blocker_violations INT,
    critical_violations INT, major_violations INT, minor_violations INT,
    info_violations INT, new_violations INT, new_blocker_violations INT,
    new_critical_violations INT, new_major_violations INT,
    new_minor_violations INT, new_info_violations INT,
    false_positive_issues INT, open_issues INT, reopened_issues INT,
    confirmed_issues INT, wont_fix_issues INT, sqale_index INT,
    sqale_rating DOUBLE, development_cost DOUBLE, new_technical_debt INT,
    sqale_debt_ratio DOUBLE, new_sqale_debt_ratio DOUBLE, code_smells INT,
    new_code_smells INT, effort_to_reach_maintainability_rating_a INT,
    new_maintainability_rating DOUBLE, new_development_cost DOUBLE,
    alert_status STRING, bugs INT, new_bugs INT,
    reliability_remediation_effort INT, new_reliability_remediation_effort INT,
    reliability_rating DOUBLE, new_reliability_rating DOUBLE,
    last_commit_date TIMESTAMP_NTZ, vulnerabilities INT,
    new_vulnerabilities INT, security_remediation_effort INT,
    new_security_remediation_effort INT, security_rating DOUBLE,
    new_security_rating DOUBLE, security_hotspots INT,
    new_security_hotspots INT, security_review_rating DOUBLE, classes INT,
    ncloc INT, functions INT, comment_lines INT, comment_lines_density DOUBLE,
    files INT, directories INT, lines INT, statements INT,
    generated_lines INT, generated_ncloc INT, ncloc_data STRING,
    comment_lines_data STRING, projects INT,
    ncloc_language_distribution STRING, new_lines INT
"""

# Measures left out because most of their rows are NULL.
SPARSE_MEASURES = """
    class_complexity function_complexity function_complexity_distribution
    file_complexity_distribution complexity_in_classes complexity_in_functions
    new_coverage new_lines_to_cover new_uncovered_lines new_line_coverage
    new_conditions_to_cover new_uncovered_conditions new_branch_coverage
    executable_lines_data public_api public_documented_api_density
    public_undocumented_api duplications_data new_duplicated_lines
    new_duplicated_blocks new_duplicated_lines_density new_violations
    new_blocker_violations new_critical_violations new_major_violations
    new_minor_violations new_info_violations new_technical_debt
    new_code_smells new_maintainability_rating new_bugs
    new_reliability_remediation_effort new_reliability_rating
    new_vulnerabilities new_security_remediation_effort new_security_rating
    new_security_hotspots directories generated_lines generated_ncloc
    ncloc_data comment_lines_data projects new_lines
""".split()

# Model features, in vector order.
BUILD_NUMERICS = """
    duration estimated_duration test_pass_count test_fail_count
    test_skip_count total_test_duration
""".split()

MEASURE_NUMERICS = """
    complexity file_complexity cognitive_complexity test_errors skipped_tests
    test_failures tests test_execution_time test_success_density coverage
    lines_to_cover uncovered_lines line_coverage conditions_to_cover
    uncovered_conditions branch_coverage duplicated_lines
    duplicated_lines_density duplicated_blocks duplicated_files violations
    blocker_violations critical_violations major_violations minor_violations
    info_violations false_positive_issues open_issues reopened_issues
    confirmed_issues wont_fix_issues sqale_index sqale_rating
    development_cost sqale_debt_ratio new_sqale_debt_ratio code_smells
    effort_to_reach_maintainability_rating_a new_development_cost bugs
    reliability_remediation_effort reliability_rating vulnerabilities
    security_remediation_effort security_rating security_hotspots
    security_review_rating classes ncloc functions comment_lines
    comment_lines_density files lines statements
""".split()

MEASURE_CATEGORIES = ["alert_status"]
QUALITY_NUMERICS = BUILD_NUMERICS + MEASURE_NUMERICS

# Evaluation metrics, in report order.
METRICS = """
    f1 weighted_precision weighted_recall accuracy area_under_ROC
    area_under_PR predicted_negative_rate
""".split()

TOP_K = 10

# --------------------------------------------------------------------------
# Derived from the lists above.


def flow_suffixes() -> list[str]:
    """``blocker_code_smell`` ... ``null_severity_security_hotspot``."""
    return [
        f"{(severity or NULL_SEVERITY_LABEL).lower()}_{kind.lower()}"
        for kind in ISSUE_TYPES
        for severity in SEVERITIES
    ]


INTRODUCED = [f"introduced_{s}" for s in flow_suffixes()]
REMOVED = [f"removed_{s}" for s in flow_suffixes()]
CURRENT = [f"current_{s}" for s in flow_suffixes()]
FLOW_COUNTS = INTRODUCED + REMOVED
FLOW_FEATURES = FLOW_COUNTS + CURRENT

BOOKKEEPING = ["processed", "ingested_at"]


_TYPES = {
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def struct(ddl: str) -> T.StructType:
    """Flat column list to a StructType; needs no running session."""
    pairs = (column.split() for column in ddl.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def ranked_pairs(name: str, value: str, size: int = TOP_K) -> list[tuple[str, str]]:
    """Column names of a wide top-k record: (name_1, value_1) ... (name_k, value_k)."""
    return [(f"{name}_{i}", f"{value}_{i}") for i in range(1, size + 1)]


def _ranked_fields(name: str, value: str) -> list[T.StructField]:
    return [
        field
        for n, v in ranked_pairs(name, value)
        for field in (T.StructField(n, T.StringType()), T.StructField(v, T.DoubleType()))
    ]


def _metric_fields(prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + m, T.DoubleType()) for m in METRICS]


MODEL_PERFORMANCE = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("data_amount", T.IntegerType())]
    + _metric_fields()
)
MODEL_INFO = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("train_data_amount", T.IntegerType())]
    + _metric_fields("train_")
    + _ranked_fields("feature", "feature_importance")
)
TOP_ISSUES = T.StructType(
    [
        T.StructField("organization", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_data_amount", T.IntegerType()),
    ]
    + _ranked_fields("issue", "issue_importance")
)

TABLES: dict[str, T.StructType] = {
    "source": struct(SOURCE_DDL),
    "jenkins_builds": struct(JENKINS_BUILDS_DDL),
    "jenkins_tests": struct(JENKINS_TESTS_DDL),
    "sonar_analyses": struct(SONAR_ANALYSES_DDL),
    "sonar_measures": struct(SONAR_MEASURES_DDL),
    "sonar_issues": struct(SONAR_ISSUES_DDL),
    "model_performance": MODEL_PERFORMANCE,
    "model_info": MODEL_INFO,
    "top_issues": TOP_ISSUES,
}

# The column that says which organization or CI server a row belongs to.
SCOPE_COLUMN = {
    "jenkins_builds": "server",
    "sonar_analyses": "organization",
    "sonar_measures": "organization",
    "sonar_issues": "organization",
}
STAMPED_TABLES = list(SCOPE_COLUMN)


def stored(table: str) -> T.StructType:
    """Columns of a staged table once it is loaded."""
    return T.StructType([*TABLES[table].fields, T.StructField("processed", T.BooleanType()), T.StructField("ingested_at", T.DateType())])


# Rows without these keys take no part in modelling.
KEY_COLUMN = {
    "sonar_analyses": "analysis_key",
    "sonar_measures": "analysis_key",
    "sonar_issues": "issue_key",
}

# --------------------------------------------------------------------------
# Shape of landed CI payloads. Only what is read is declared, so from_json
# skips everything else.
BUILD_PAYLOAD = """
    id STRING, number BIGINT, result STRING, duration BIGINT,
    estimatedDuration BIGINT,
    actions ARRAY<STRUCT<_class: STRING, failCount: INT, skipCount: INT,
        passCount: INT, totalCount: INT,
        lastBuiltRevision: STRUCT<SHA1: STRING>>>,
    changeSet STRUCT<items: ARRAY<STRUCT<commitId: STRING, date: STRING>>>
"""
_SUITES = """ARRAY<STRUCT<name: STRING,
    cases: ARRAY<STRUCT<name: STRING, duration: DOUBLE, status: STRING>>>>"""
TEST_REPORT = f"""
    _class STRING, failCount INT, skipCount INT, passCount INT,
    totalCount INT, duration DOUBLE, suites {_SUITES},
    childReports ARRAY<STRUCT<result: STRUCT<duration: DOUBLE, suites: {_SUITES}>>>
"""
JOB_NODE = """
    _class STRING, fullName STRING, name STRING,
    jobs ARRAY<STRUCT<_class: STRING, fullName: STRING, name: STRING>>
"""
