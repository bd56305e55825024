"""Flow counts that are written once: the rows of the plain operator, wide rows gathered only where projects share a key."""

from pyspark.sql import functions as F

from buildlode.domain import Domain
from buildlode.operators import issues, quality
from test_relational import ISSUE, issue


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_rows_are_those_of_the_plain_operator(spark):
    rows = [issue(project=p, created=c, current=c, status=s, processed=n) for p in ("p", "q", None) for c in ("a1", None) for s in ("OPEN", "CLOSED") for n in (True, False)]
    rows += [issue(project=p, created="a2") for p in ("p", "q")] + [issue(created="a3"), issue(current="a4", status="RESOLVED")]
    df = spark.createDataFrame(rows, ISSUE).withColumn("batch", F.explode(F.array(F.lit(0), F.lit(1))))
    for flag in (False, True):
        assert same(issues.stored_flow_counts(df, flag, ["batch"]), issues.issue_flow_counts(df, flag, ["batch"]))
    d = Domain(spark, "/root/testdata/sf0.001")
    for table in (d.shared_issues, d.sonar_issues, d.sonar_issues.where("false")):
        assert same(issues.stored_flow_counts(table), issues.issue_flow_counts(table))


def test_keys_of_one_project_are_not_gathered(spark):
    alone = spark.createDataFrame([issue(created="a1"), issue(current="a1", status="CLOSED"), issue(project="q", created="a2")], ISSUE)
    assert "collect_list" not in plan(issues.stored_flow_counts(alone))


def test_totals_may_join_after_the_builds(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    flows = issues.stored_flow_counts(d.shared_issues)
    late = quality.builds_x_flows(d.jenkins_builds, flows, d.sonar_analyses, ["job"], totals=issues.running_totals_by_date(flows))
    early = quality.builds_x_flows(d.jenkins_builds, issues.running_issue_totals(flows), d.sonar_analyses, ["job"])
    assert same(late, early) and not late.isEmpty()
