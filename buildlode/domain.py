"""Study tables derived from the general test tables, as portable SQL.

One text per view runs unchanged on Spark and on a plain SQL engine, so a query
over the derived tables can be checked by SQL over the very same rows. Views
keep every row of their base table; the ``processed`` flag is only a column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .session import prepare

_PROJECT = "concat('p', cast({k} % 50 as string))"
_ORG = "concat('org', cast(({k} % 50) % 3 as string))"


def _measure(i: int, name: str, double: bool) -> str:
    value = f"(o_orderkey * ({i} + 7) + o_custkey) % (101 + {i})"
    value = f"cast({value} as double) / 4.0" if double else f"cast({value} as int)"
    return f"case when (o_orderkey + {i}) % 11 = 0 then null else {value} end {name}"


def _measures_columns() -> str:
    kinds = {f.name: f.dataType.simpleString() for f in schemas.TABLES["sonar_measures"]}
    return ",\n       ".join(
        _measure(i, name, kinds[name] == "double")
        for i, name in enumerate(schemas.MEASURE_NUMERICS, 1)
    )


def _other_measures() -> str:
    """Measures that no study uses: the sparse ones have a value in one row of 17."""
    used = ["organization", "project", "analysis_key", *schemas.MEASURE_NUMERICS, *schemas.MEASURE_CATEGORIES]
    rest = [n for n in schemas.TABLES["sonar_measures"].names if n not in used]
    kinds = {f.name: f.dataType.simpleString() for f in schemas.TABLES["sonar_measures"]}
    values = {"int": "cast(o_custkey % 90 as int)", "bigint": "cast(o_custkey % 90 as bigint)",
              "double": "cast(o_custkey % 90 as double) / 4.0", "string": "concat('v', cast(o_custkey % 90 as string))", "timestamp_ntz": "o_orderdate"}
    return ",\n       ".join(
        f"case when o_orderkey % {17 if name in schemas.SPARSE_MEASURES else 2} = {i % 17 % 2} then {values[kinds[name]]} end {name}"
        for i, name in enumerate(rest)
    )


def _ranked(name: str, value: str, key: str) -> str:
    """Ten (name, value) columns with NULL slots and repeated pairs."""
    cells = []
    for i, (n, v) in enumerate(schemas.ranked_pairs(name, value), 1):
        empty = f"({key} + {i}) % 7 = 0"
        cells.append(f"case when {empty} then null else concat('java:S', cast(({key} * {i}) % 12 as string)) end {n}")
        cells.append(f"case when {empty} then null else cast(({key} + {i}) % 8 as double) / 8.0 end {v}")
    return ",\n       ".join(cells)


def _metric_columns(key: str, prefix: str = "") -> str:
    return ", ".join(
        f"case when ({key} + {i}) % 19 = 0 then null else cast(({key} * {i}) % 16 as double) / 16.0 end {prefix}{m}"
        for i, m in enumerate(schemas.METRICS, 1)
    )


_TS = "substr(cast(ts as string), 1, 19)"
_COMMIT_A = f"""concat('{{"commitId":"c', cast(event_id as string), '","date":"', {_TS}, ' +0530"}}')"""
_COMMIT_B = f"""concat('{{"commitId":"d', cast(event_id as string), '","date":"', replace({_TS}, ' ', 'T'), '.000Z"}}')"""
_COUNTS = """concat('"failCount":', cast(event_id % 5 as string), ',"skipCount":', cast(event_id % 3 as string),
           case when event_id % 4 = 0 then concat(',"passCount":', cast(event_id % 97 as string))
                when event_id % 4 = 1 then concat(',"totalCount":', cast(event_id % 97 + 10 as string))
                else '' end)"""
_SUITE = """concat('{"name":"org.acme.m', cast(event_id % 9 as string), '.T', cast(user_id % 13 as string),
           '","cases":[{"name":"case', chr(92), 'n', cast(event_id % 17 as string), '","duration":', cast(event_id % 30 as string), '.5,"status":"PASSED"},',
           '{"name":"plain","duration":0.25,"status":"', case when event_type = 'error' then 'FAILED' else 'PASSED' end, '"}]}')"""

VIEWS: dict[str, str] = {
    "sonar_analyses": f"""
select {_ORG.format(k='o_orderkey')} organization,
       {_PROJECT.format(k='o_orderkey')} project,
       concat('a', cast(o_orderkey as string)) analysis_key,
       o_orderdate date, o_orderpriority project_version,
       concat('rev', cast(o_orderkey as string)) revision,
       o_custkey % 9 < 7 processed, cast(o_orderdate as date) ingested_at
from $orders""",
    "sonar_issues": f"""
select {_ORG.format(k='l_orderkey')} organization,
       {_PROJECT.format(k='l_orderkey')} project,
       concat('a', cast(l_orderkey + 50 * l_linenumber as string)) current_analysis_key,
       concat('a', cast(l_orderkey as string)) creation_analysis_key,
       concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string),
                 cast(l_suppkey as string), cast(l_linenumber as string),
                 cast(cast(l_quantity as int) as string)) issue_key,
       case l_partkey % 4 when 0 then 'CODE_SMELL' when 1 then 'BUG'
            when 2 then 'VULNERABILITY' else 'SECURITY_HOTSPOT' end type,
       concat('java:S', cast(l_partkey % 40 as string)) rule,
       case l_suppkey % 6 when 0 then 'BLOCKER' when 1 then 'CRITICAL' when 2 then 'MAJOR'
            when 3 then 'MINOR' when 4 then 'INFO' else null end severity,
       case l_linenumber when 1 then 'OPEN' when 2 then 'REOPENED' when 3 then 'CONFIRMED'
            when 4 then 'TO_REVIEW' when 5 then 'RESOLVED' when 6 then 'CLOSED'
            else 'REVIEWED' end status,
       case when l_linenumber >= 5 then 'FIXED' else null end resolution,
       cast(l_suppkey % 60 as int) effort, cast(l_suppkey % 60 as int) debt,
       l_returnflag tags,
       o_orderdate creation_date, l_shipdate update_date,
       case when l_linenumber >= 5 then l_shipdate else null end close_date,
       l_partkey % 10 < 8 processed, cast(l_shipdate as date) ingested_at
from $lineitem join $orders on l_orderkey = o_orderkey""",
    "jenkins_builds": """
select concat('https://ci', cast(user_id % 3 as string), '.example.com/') server,
       concat('job', cast(user_id % 20 as string)) job,
       cast(event_id as int) build_number,
       case event_type when 'error' then 'FAILURE' when 'signup' then 'UNSTABLE'
            else 'SUCCESS' end result,
       cast(floor(value * 1000) as bigint) duration,
       cast(floor(value * 900) as bigint) estimated_duration,
       concat('rev', cast(event_id as string)) revision_number,
       concat('c', cast(event_id as string)) commit_id, ts commit_ts,
       case when event_id % 7 = 0 then null else cast(event_id % 97 as int) end test_pass_count,
       case when event_id % 7 = 0 then null when event_type = 'error'
            then cast(event_id % 5 as int) else 0 end test_fail_count,
       case when event_id % 7 = 0 then null else cast(event_id % 3 as int) end test_skip_count,
       case when event_id % 7 = 0 then null else value end total_test_duration,
       user_id % 10 < 8 processed, cast(ts as date) ingested_at
from $events""",
    "sonar_measures": f"""
select {_ORG.format(k='o_orderkey')} organization,
       {_PROJECT.format(k='o_orderkey')} project,
       concat('a', cast(o_orderkey as string)) analysis_key,
       {_measures_columns()},
       {_other_measures()},
       case o_orderstatus when 'F' then 'OK' when 'O' then 'ERROR' else null end alert_status,
       o_custkey % 10 < 8 processed, cast(o_orderdate as date) ingested_at
from $orders""",
    "source": """
select concat('org', cast(k as string)) sonar_org_key,
       concat('https://ci', cast(k as string), '.example.com/') jenkins_server,
       cast(k % 2 as int) batch_number
from (select distinct s_suppkey % 3 k from $supplier) s""",
    "model_performance": f"""
select concat('Model_', o_orderpriority) model, cast(o_custkey % 40 as int) data_amount,
       {_metric_columns('o_custkey')},
       cast(o_orderdate as date) processing_date
from $orders""",
    "model_info": f"""
select concat('Model_', p_type) model, p_size train_data_amount,
       {_metric_columns('p_partkey', 'train_')},
       {_ranked('feature', 'feature_importance', 'p_partkey')}
from $part""",
    "top_issues": f"""
select {_ORG.format(k='o_custkey')} organization, {_PROJECT.format(k='o_custkey')} project,
       concat('Model_', o_orderpriority) model, cast(o_custkey % 40 as int) input_data_amount,
       {_ranked('issue', 'issue_importance', 'o_custkey')},
       cast(o_orderdate as date) processing_date
from $orders""",
    # Scored rows: a label, a hard prediction and a score of many digits per build.
    "predictions": """
select concat('Model_', event_type) model, event_id row_id,
       case when user_id % 10 < 4 then 1.0 else 0.0 end label,
       case when event_id % 10 < 5 then 1.0 else 0.0 end prediction,
       cast((event_id * 7919 + user_id * 104729) % 1000003 as double) / cast(1000003 as double) score
from $events""",
    # Landed CI payloads: build text, optional test report text.
    "build_payloads": f"""
select concat('https://ci', cast(user_id % 3 as string), '.example.com/') server,
       concat('Folder/Job ', cast(user_id % 20 as string)) job, event_id,
       concat('{{',
         case when event_id % 5 = 0 then '' when event_id % 5 = 1 then '"id":"nightly",'
              else concat('"id":"', cast(event_id as string), '",') end,
         '"number":', cast(event_id as string),
         ',"result":', case event_type when 'error' then '"FAILURE"' when 'signup' then 'null' else '"SUCCESS"' end,
         ',"duration":', cast(cast(floor(value * 1000) as bigint) as string),
         ',"estimatedDuration":', cast(cast(floor(value * 900) as bigint) as string),
         ',"actions":[{{}},{{"_class":"hudson.tasks.junit.TestResultAction",', {_COUNTS}, '}},',
         '{{"_class":"hudson.plugins.git.util.BuildData","lastBuiltRevision":{{"SHA1":"old', cast(event_id as string), '"}}}},',
         '{{"_class":"hudson.plugins.git.util.BuildData","lastBuiltRevision":{{"SHA1":"rev', cast(event_id as string), '"}}}}]',
         case when event_id % 3 = 0 then '' when event_id % 3 = 1
              then concat(',"changeSet":{{"items":[', {_COMMIT_A}, ']}}')
              else concat(',"changeSet":{{"items":[', {_COMMIT_A}, ',', {_COMMIT_B}, ']}}') end,
         '}}') payload,
       case when event_id % 4 = 3 then null
            when event_id % 8 < 4 then concat('{{"_class":"hudson.tasks.junit.TestResult",', {_COUNTS},
                 ',"duration":', cast(event_id % 100 as string), '.25,"suites":[', {_SUITE}, ']}}')
            else concat('{{"_class":"hudson.maven.reporters.SurefireAggregatedReport",', {_COUNTS},
                 ',"childReports":[{{"result":{{"duration":', cast(event_id % 100 as string), '.5,"suites":[', {_SUITE},
                 ']}}}},{{"result":{{"suites":[', {_SUITE}, ']}}}}]}}') end report
from $events""",
    "job_nodes": """
select c_custkey node_id,
       case when c_custkey % 3 = 0 then concat('{"_class":"hudson.model.FreeStyleProject","fullName":"Solo/', c_name, '"}')
            else concat('{"_class":"com.cloudbees.hudson.plugins.folder.Folder","fullName":"Team/', c_mktsegment,
                 '","jobs":[{"_class":"hudson.model.FreeStyleProject","name":"', c_name, '"},',
                 '{"_class":"jenkins.branch.OrganizationFolder","fullName":"Other/', c_name, '"}]}') end node
from $customer""",
}


# A job tree four folders deep, landed in parts: each row lists one child of its folder.
# Some folders were never landed and some list their own root again.
_AREA = "concat('area', cast(c_custkey % 5 as string))"
_TEAM = f"concat({_AREA}, '/t', cast(c_custkey % 4 as string))"
_GROUP = f"concat({_TEAM}, '/g', cast(c_custkey % 3 as string))"
_FOLDER = '{"_class":"com.cloudbees.hudson.plugins.folder.Folder","fullName":"'
VIEWS["job_tree_nodes"] = f"""
select distinct concat('{_FOLDER}', {_AREA}, '","jobs":[{{"_class":"jenkins.branch.OrganizationFolder","name":"t', cast(c_custkey % 4 as string), '"}}]}}') node from $customer
union all select distinct concat('{_FOLDER}', {_TEAM}, '","jobs":[{{"_class":"com.cloudbees.hudson.plugins.folder.Folder","name":"g', cast(c_custkey % 3 as string), '"}},',
       '{{"_class":"com.cloudbees.hudson.plugins.folder.Folder","fullName":"', {_TEAM}, '/lost"}}]}}') from $customer
union all select concat('{_FOLDER}', {_GROUP}, '","jobs":[{{"_class":"hudson.model.FreeStyleProject","name":"', c_name, '"}}]}}') from $customer
union all select distinct concat('{_FOLDER}', {_GROUP}, '","jobs":[{{"_class":"org.x.WorkflowMultiBranchProject","fullName":"', {_GROUP}, '/deep"}}]}}') from $customer where c_custkey % 7 = 0
union all select concat('{{"_class":"org.x.WorkflowMultiBranchProject","fullName":"', {_GROUP}, '/deep","jobs":[{{"_class":"org.x.WorkflowJob","name":"b', cast(c_custkey as string), '"}},',
       '{{"_class":"com.cloudbees.hudson.plugins.folder.Folder","fullName":"', {_AREA}, '"}}]}}') from $customer where c_custkey % 7 = 0
union all select concat('{{"_class":"hudson.model.FreeStyleProject","fullName":"Solo/', c_name, '"}}') from $customer where c_custkey % 11 = 0"""


def _shared_key(name: str) -> str:
    number = f"cast(substr({name}, 2) as bigint)"
    return f"""case when {number} % 31 = 0 then null when {number} % 10 = 0
            then concat('s', cast({number} % 1009 as string)) else {name} end {name}"""


# Issues whose analysis keys are missing or lie in several projects here and there.
VIEWS["shared_issues"] = f"""
select organization, project, {_shared_key('current_analysis_key')}, {_shared_key('creation_analysis_key')},
       issue_key, type, rule, severity, status, creation_date, update_date, processed
from ({VIEWS['sonar_issues']}) i"""

_BASE = re.compile(r"\$(\w+)")


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named views over registered base tables."""
    return "WITH " + ",\n".join(f"{n} AS ({_BASE.sub(r'\1', VIEWS[n])})" for n in names) + "\n"


class Domain:
    """The derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = _BASE.sub(lambda m: f"parquet.`{self.sf_dir}/{m[1]}.parquet`", VIEWS[name])
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)
