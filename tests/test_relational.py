"""Hand-made rows for the cases the generated tables do not hold."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from buildlode import schemas, session
from buildlode.functions import scalars as S
from buildlode.operators import delta, filters, issues, landed, quality, rules
from buildlode.sources import sinks, staging, tables
from buildlode.streaming import ingest

ISSUE = "project string, creation_analysis_key string, current_analysis_key string, type string, severity string, status string, creation_date timestamp_ntz, update_date timestamp_ntz, processed boolean, rule string"


def day(n, hour=0):
    return dt.datetime(2020, 1, n, hour)


def issue(project="p", created="a1", current="a1", kind="BUG", severity="MAJOR", status="OPEN", at=day(1), updated=day(2), processed=True, rule="r1"):
    return (project, created, current, kind, severity, status, at, updated, processed, rule)


def flows(spark, *rows):
    return issues.issue_flow_counts(spark.createDataFrame(list(rows), ISSUE))


def test_null_result_is_fail(spark):
    df = spark.createDataFrame([("SUCCESS",), ("UNSTABLE",), (None,)], "result string")
    got = df.select(S.binary_result(F.col("result")).alias("r"), S.fail_label(F.col("result")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("SUCCESS", 0.0), ("FAIL", 1.0), ("FAIL", 1.0)]


def test_null_and_unlisted_severity_type_status(spark):
    got = flows(
        spark,
        issue(severity=None),
        issue(severity="ODD", created="a2"),
        issue(kind="ODD", created="a3"),
        issue(status="ODD", created="a4"),
    ).collect()
    by_key = {r.analysis_key: r for r in got}
    assert set(by_key) == {"a1", "a2", "a3"}
    assert by_key["a1"].introduced_null_severity_bug == 1
    assert all(by_key[k][c] == 0 for k in ("a2", "a3") for c in schemas.FLOW_COUNTS)


def test_null_keys_never_meet(spark):
    got = flows(spark, issue(created=None), issue(current=None, status="CLOSED")).collect()
    assert len(got) == 2 and all(r.analysis_key is None for r in got)


def test_same_key_in_two_projects_makes_cross_pairs(spark):
    got = flows(
        spark,
        issue(project="p"),
        issue(project="q"),
        issue(project="p", status="CLOSED"),
        issue(project="q", status="CLOSED"),
    ).collect()
    assert sorted(r.project for r in got) == ["p", "p", "q", "q"]


def test_removed_only_takes_update_date(spark):
    (row,) = flows(spark, issue(status="RESOLVED", at=day(1), updated=day(9))).collect()
    assert row.date == day(9) and row.introduced_major_bug == 0 and row.removed_major_bug == 1


def test_flow_keys_and_new_flag(spark):
    df = spark.createDataFrame([issue(processed=True), issue(created="a2", processed=False)], ISSUE).withColumn("batch_number", F.lit(3))
    got = issues.issue_flow_counts(df, with_new_flag=True, keys=["batch_number"]).collect()
    assert {(r.batch_number, r.analysis_key, r.has_new) for r in got} == {(3, "a1", False), (3, "a2", True)}


def test_running_totals_peers_nulls_and_hours(spark):
    rows = [("p", f"a{i}", d, n) for i, (d, n) in enumerate([(None, 5), (day(1, 3), 1), (day(1, 3), 2), (day(1, 9), 4), (day(3), -1), (None, 1)])]
    rows += [("q", "b", day(1), 7)]
    base = spark.createDataFrame(rows, "project string, analysis_key string, date timestamp_ntz, net long")
    zero = {c: F.lit(0).cast("long") for c in schemas.FLOW_COUNTS}
    zero["introduced_major_bug"] = F.greatest("net", F.lit(0).cast("long"))
    zero["removed_major_bug"] = F.greatest(-F.col("net"), F.lit(0).cast("long"))
    got = issues.running_issue_totals(base.withColumns(zero)).collect()
    total = {r.analysis_key: r.current_major_bug for r in got}
    assert total == {"a0": 6, "a5": 6, "a1": 9, "a2": 9, "a3": 13, "a4": 12, "b": 7}


def test_running_totals_equal_plain_window_under_skew(spark):
    # One project holds most rows, many of them on one date.
    base = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("project"),
        F.concat(F.lit("a"), F.col("id")).alias("analysis_key"),
        F.when(F.col("id") % 3 > 0, F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(id % 400 as int))")).alias("date"),
        *[((F.col("id") * (i + 3)) % 5).alias(c) for i, c in enumerate(schemas.FLOW_COUNTS)],
    )
    plain = base.selectExpr("*", *[
        f"sum({i} - {r}) over (partition by project order by date) as {c}"
        for i, r, c in zip(schemas.INTRODUCED, schemas.REMOVED, schemas.CURRENT)
    ])
    got = issues.running_issue_totals(base).select(*plain.columns)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_commit_times(spark):
    texts = ["2020-01-01 10:00:00 +0530", "2020-01-01 10:00:00 -0130", "2020-01-01T10:00:00.000Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.commit_timestamp(F.col("t")).alias("t"))
    base = dt.datetime(2020, 1, 1)
    assert [r.t for r in df.collect()] == [base.replace(hour=4, minute=30), base.replace(hour=11, minute=30), base.replace(hour=10), None]


PAYLOAD = '{"id":"7","result":"SUCCESS","actions":[{},{"_class":"x.TestResultAction","failCount":2,"skipCount":1,"totalCount":10}]%s}'


def landed_rows(spark, payload, report=None):
    return spark.createDataFrame([("s", "j", payload, report)], "server string, job string, payload string, report string")


def test_pass_count_and_commits(spark):
    two = ',"changeSet":{"items":[{"commitId":"c1","date":"2020-01-01 10:00:00 +0000"},{"commitId":"c2"},{"note":"x"}]}'
    rows = landed.flatten_builds(landed_rows(spark, PAYLOAD % two)).collect()
    assert {(r.commit_id, r.test_pass_count) for r in rows} == {("c1", 7), ("c2", 7)}
    assert [r.commit_id for r in landed.flatten_builds(landed_rows(spark, PAYLOAD % two), last_only=True).collect()] == ["c2"]
    (none,) = landed.flatten_builds(landed_rows(spark, PAYLOAD % "")).collect()
    assert none.commit_id is None and none.build_number == 7 and none.total_test_duration is None
    assert landed.flatten_builds(landed_rows(spark, '{"result":"SUCCESS"}')).count() == 0


def test_child_reports(spark):
    suite = '{"name":"a.b.C","cases":[{"name":"x\\ny","duration":1.5,"status":"PASSED"}]}'
    agg = '{"_class":"h.%s","failCount":0,"skipCount":0,"childReports":[{"result":{"suites":[' + suite + ']}},{"result":{}}]}'
    df = landed_rows(spark, PAYLOAD % "", agg % "MatrixTestResult")
    assert landed.flatten_builds(df).first().total_test_duration is None
    (case,) = landed.flatten_tests(df).collect()
    assert (case.package, case["class"], case.name, case.build_number) == ("a.b", "C", "x_y", 7)
    assert landed.flatten_tests(landed_rows(spark, PAYLOAD % "", agg % "Unknown")).count() == 0


def test_delta_plus_known_is_the_full_join(spark):
    feats = {c: F.lit(1.0) for c in schemas.MEASURE_NUMERICS + schemas.MEASURE_CATEGORIES}
    ids = spark.range(60)
    flag = lambda n: F.when(F.col("id") % n == 0, F.lit(False)).when(F.col("id") % n == 1, F.lit(None)).otherwise(F.lit(True))
    key = lambda p: F.concat(F.lit(p), F.col("id") % 20)
    builds = ids.select(F.col("id").alias("build_number"), F.lit("SUCCESS").alias("result"), key("r").alias("revision_number"), flag(4).alias("processed"))
    analyses = ids.select(F.concat(F.lit("k"), "id").alias("analysis_key"), key("r").alias("revision"), flag(5).alias("processed"))
    measures = ids.select(F.concat(F.lit("k"), "id").alias("analysis_key"), flag(6).alias("processed")).withColumns(feats)
    got = delta.incremental_delta(builds, measures, analyses).count()
    full = builds.join(analyses.withColumnRenamed("processed", "ap"), F.col("revision_number") == F.col("revision")).join(
        measures.withColumnRenamed("processed", "mp"), "analysis_key"
    )
    assert got == full.where("processed <=> false or ap <=> false or mp <=> false").count()
    new_build_new_measure = full.where("processed <=> false and mp <=> false").count()
    assert 0 < new_build_new_measure < got


def test_batches_keep_their_own_sources(spark):
    src = spark.createDataFrame([("o1", "s1", 0), ("o2", "s2", 2)], "sonar_org_key string, jenkins_server string, batch_number int")
    got = [(r.batch_number, r.org_keys, r.servers) for r in tables.batch_registry(src).orderBy("batch_number").collect()]
    assert got == [(0, ["o1"], ["s1"]), (1, [], []), (2, ["o2"], ["s2"])]
    assert tables.batch_registry(src.limit(0)).count() == 0
    builds = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "server string, build_number int")
    assert {(r.build_number, r.batch_number) for r in quality.by_batch(builds, src, "jenkins_builds").collect()} == {(1, 0), (2, 2)}


def test_scope_by_list_and_by_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "server string")
    assert filters.filter_scope(df, "server", ["a", "z"]).count() == 1
    assert filters.filter_scope(df, "server", [f"x{i}" for i in range(2000)] + ["b"]).count() == 1


def test_rule_vector_sums_equal_counts(spark):
    df = spark.createDataFrame([issue(rule="r1"), issue(rule="r1"), issue(rule="r2", status="CLOSED"), issue(rule="new")], ISSUE)
    cells = rules.rule_cells(rules.rule_counts(df), ["r1", "r2"])
    (row,) = rules.rule_vectors(cells, 4).collect()
    assert dict(zip(rules.feature_names(["r1", "r2"]), row.features.toArray())) == {"removed_r1": 0, "removed_r2": 1, "introduced_r1": 2, "introduced_r2": 0}


def test_append_load_is_idempotent_and_keeps_nulls_apart(spark, folder):
    rows = spark.createDataFrame([("o", "p", None, day(1), "v", None), ("o", "p", "k", day(1), "v", "r")], schemas.TABLES["sonar_analyses"])
    for _ in range(3):
        staging.append_load(rows, f"{folder}/t", "sonar_analyses")
    stored = spark.read.parquet(f"{folder}/t")
    assert stored.count() == 2 and stored.where("processed").count() == 0


def test_stream_reads_each_staged_file_once(spark, folder):
    schema = schemas.TABLES["sonar_analyses"]
    first = spark.createDataFrame([("o", "p", "k1", day(1), "v", "r1")], schema)
    second = spark.createDataFrame([("o", "p", "k1", day(1), "v", "r1"), ("o", "p", "k2", day(2), "v", "r2")], schema)
    run = lambda: ingest.stream_staged_ingest(spark, folder + "/in", "sonar_analyses", folder + "/out", folder + "/state").awaitTermination()
    staging.staged_table_write(first, folder + "/in", "sonar_analyses", "o", "one")
    run()
    staging.staged_table_write(second, folder + "/in", "sonar_analyses", "o", "two")
    run()
    run()
    assert sorted(r.analysis_key for r in spark.read.parquet(folder + "/out").collect()) == ["k1", "k2"]


def test_archive_files_only_with_all(spark, folder):
    df = spark.createDataFrame([("o", "p", "k1", day(1), "v", "r1")], schemas.TABLES["sonar_analyses"])
    df.write.options(header=True, quote='"', escape='"', timestampNTZFormat=staging.TIMESTAMP_FORMAT).csv(f"{folder}/sonarcloud/o/analyses/one.csv")
    assert staging.staged_csv_scan(spark, folder, "sonar_analyses").count() == 0
    assert staging.staged_csv_scan(spark, folder, "sonar_analyses", all_files=True).collect() == df.collect()


def test_null_integers_stay_integers(spark, folder):
    schema = schemas.TABLES["jenkins_builds"]
    row = tuple({"server": "s", "job": "J b", "build_number": 1}.get(c) for c in schema.names)
    staging.staged_csv_write(spark.createDataFrame([row], schema), folder, "jenkins_builds", "s")
    back = staging.staged_csv_scan(spark, folder, "jenkins_builds")
    assert back.schema.simpleString() == schema.simpleString() and tuple(back.first()) == row


def test_stamp_and_high_water_mark(spark):
    df = spark.createDataFrame([(1, False, dt.date(2020, 1, 1)), (2, False, dt.date(2020, 2, 1))], "id int, processed boolean, ingested_at date")
    assert [r.processed for r in delta.stamp_processed(df, F.lit(dt.date(2020, 1, 15))).orderBy("id").collect()] == [True, False]
    form = "server string, job string, build_number int"
    stored = spark.createDataFrame([("s1", "j", 100), ("s2", "j", 3)], form)
    fetched = spark.createDataFrame([("s1", "j", 100), ("s2", "j", 4), ("s2", "n", 0)], form)
    assert {tuple(r) for r in delta.above_high_water_mark(fetched, stored).collect()} == {("s2", "j", 4), ("s2", "n", 0)}


def build_row(**values):
    return tuple(values.get(c) for c in schemas.TABLES["jenkins_builds"].names)


def test_staged_write_replaces_only_its_own_files(spark, folder):
    schema = schemas.TABLES["jenkins_builds"]
    for rows in ([("a", 1)], [("b", 2)], [("a", 3)], [(None, 4)]):
        df = spark.createDataFrame([build_row(server="s", job=j, build_number=n) for j, n in rows], schema)
        staging.staged_csv_write(df, folder, "jenkins_builds", "s")
    back = staging.staged_csv_scan(spark, folder, "jenkins_builds").collect()
    assert {(r.job, r.build_number) for r in back} == {("b", 2), ("a", 3), (None, 4)}


def write_file(folder, text, name="x"):
    os.makedirs(f"{folder}/sonarcloud/o/analyses", exist_ok=True)
    with open(f"{folder}/sonarcloud/o/analyses/{name}_staging.csv", "w") as f:
        f.write(text)


def test_staged_columns_are_taken_by_name(spark, folder):
    write_file(folder, 'date,more,organization,project,analysis_key,project_version,revision\n2020-01-01T10:00:00.000,z,o,"p\nq",k,"1,""2",r\n')
    write_file(folder, "organization,project,analysis_key,date,project_version,revision\no,p2,k2,2020-01-02 00:00:00,,r2\n", "y")
    a, b = sorted(staging.staged_csv_scan(spark, folder, "sonar_analyses").collect(), key=lambda r: r.analysis_key)
    assert (a.project, a.project_version, a.date) == ("p\nq", '1,"2', dt.datetime(2020, 1, 1, 10)) and b.project_version is None


@pytest.mark.parametrize("text", [
    "organization,project,analysis_key,date,project_version\no,p,k,2020-01-01 00:00:00,v\n",
    "organization,project,analysis_key,date,project_version,revision\no,p,k,yesterday,v,r\n",
])
def test_unreadable_staged_files_are_loud(spark, folder, text):
    write_file(folder, text)
    with pytest.raises(Exception, match="lacks the columns|CAST_INVALID_INPUT"):
        staging.staged_csv_scan(spark, folder, "sonar_analyses").collect()


def test_load_does_not_need_a_marker_file(spark, folder):
    rows = spark.createDataFrame([("o", "p", "k", day(1), "v", "r")], schemas.TABLES["sonar_analyses"])
    for _ in range(2):
        staging.append_load(rows, f"{folder}/t", "sonar_analyses")
        for marker in glob.glob(f"{folder}/t/**/_SUCCESS", recursive=True):
            os.remove(marker)
    assert spark.read.parquet(f"{folder}/t").count() == 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Fake, "x")


def test_intermediates_are_deleted(spark, folder):
    with session.intermediates(spark):
        path = session.shared_dir(spark, "t")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_artefact_check(spark, folder):
    store = sinks.Artefacts(spark, folder)
    assert store.usable_mode("incremental") == "first" and len(store.missing()) == 18 + 6 + 1
    for name in sinks.expected_artefacts():
        spark.range(1).write.parquet(store.path(name))
    assert store.missing() == [] and store.usable_mode("incremental") == "incremental"


def landed_build(spark, **build):
    return spark.createDataFrame([("s", "j", json.dumps(build), None)], "server string, job string, payload string, report string")


def test_repeated_commit_is_one_row_with_its_last_date(spark):
    items = [{"commitId": c, "date": f"2020-01-0{n}T00:00:00.000Z"} for n, c in enumerate(["a", "b", "a"], 1)]
    rows = landed.flatten_builds(landed_build(spark, id="7", number=7, changeSet={"items": items})).collect()
    assert {(r.commit_id, r.commit_ts) for r in rows} == {("a", day(3)), ("b", day(2))}


def test_build_numbers_beyond_int_fall_back(spark):
    assert landed.flatten_builds(landed_build(spark, id="20200101120000123", number=12)).first().build_number == 12
    lost = landed_build(spark, id="20200101120000123")
    assert landed.flatten_builds(lost).count() == 0
    assert tuple(landed.unnumbered(lost).first()) == (1, 1)


def test_keys_of_several_projects_pair_their_sides(spark):
    got = flows(
        spark,
        issue(project="p", created="k"),
        issue(project="q", current="k", status="CLOSED"),
        issue(project="r", current="k", status="CLOSED"),
        issue(project=None, created="n"),
        issue(project="p", created="n"),
        issue(project="p", created=None),
        issue(project="p", current=None, status="CLOSED"),
    )
    flow = lambda r: (r.project, r.analysis_key, sum(r[c] for c in schemas.INTRODUCED), sum(r[c] for c in schemas.REMOVED))
    assert sorted(map(flow, got.collect()), key=str) == sorted(
        [("p", "k", 1, 1), ("p", "k", 1, 1), (None, "n", 1, 0), ("p", "n", 1, 0), ("p", None, 1, 0), ("p", None, 0, 1)], key=str
    )
