"""Streamed issue counts: merged state, dates, replays and compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buildlode.operators import issues
from buildlode.sources import staging
from buildlode.sources.files import listed
from buildlode.streaming import ingest

COLUMNS = "organization string, project string, current_analysis_key string, creation_analysis_key string, issue_key string, type string, rule string, severity string, status string, resolution string, effort int, debt int, tags string, creation_date timestamp_ntz, update_date timestamp_ntz, close_date timestamp_ntz"


def rows(spark, part):
    day = lambda n: None if n is None else dt.datetime(2020, 1, n)
    base = [
        # A later batch brings an earlier date and a missing one; k lies in two projects.
        ("p", "k", "k", "OPEN", [5, 2, None][part], 9),
        ("q", "k", "k", "CLOSED", 1, [3, 8, 4][part]),
        ("p", None, None, ["OPEN", "CLOSED", "OPEN"][part], 1, 1),
        ("p", f"only{part}", f"only{part}", "OPEN", None, None),
    ]
    data = [
        ("o", p, cur, new, f"{part}-{i}", "BUG", "r", ["MAJOR", None, "ODD"][part], status, None, 1, 1, "t", day(made), day(seen), None)
        for i, (p, cur, new, status, made, seen) in enumerate(base)
    ]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture()
def streamed(spark, folder):
    """Runs a batch per part; returns the state folder and all rows."""
    path, everything = f"{folder}/counts", None
    for part in range(3):
        staging.staged_table_write(rows(spark, part), f"{folder}/in", "sonar_issues", "o", f"part{part}")
        stream = ingest.staged_stream(spark, f"{folder}/in", "sonar_issues")
        ingest.stream_issue_counts(stream, path, f"{folder}/state", compact_every=2).awaitTermination()
        everything = rows(spark, part) if everything is None else everything.unionAll(rows(spark, part))
    return path, everything


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def names(spark, path):
    return [p.rpartition("/")[2] for p in listed(spark, f"{path}/*=*")]


def test_flows_with_dates_equal_the_batch_operator(spark, streamed):
    path, everything = streamed
    assert names(spark, path) == ["batch=0", "batch=1", "batch=2", "upto=1"]
    assert same(ingest.streamed_flows(spark, path), issues.issue_flow_counts(everything))


def test_replayed_batches_and_merges_change_nothing(spark, streamed):
    path, everything = streamed
    want = issues.issue_flow_counts(everything)
    ingest.cell_counts(rows(spark, 2)).write.mode("overwrite").parquet(f"{path}/batch=2")
    ingest.compact_counts(spark, path, 2)
    assert same(ingest.streamed_flows(spark, path), want)
    ingest.compact_counts(spark, path, 3)
    ingest.compact_counts(spark, path, 3)
    assert names(spark, path) == ["batch=2", "upto=1", "upto=2"]
    assert same(ingest.streamed_flows(spark, path), want)


def test_an_unfinished_merge_is_not_read(spark, streamed):
    path, everything = streamed
    ingest.latest_counts(spark, path).write.parquet(f"{path}/upto=9")
    (mark,) = listed(spark, f"{path}/upto=9/_SUCCESS")
    from buildlode.sources.files import remove

    remove(spark, mark)
    assert same(ingest.streamed_flows(spark, path), issues.issue_flow_counts(everything))


def test_a_stream_without_files_has_an_empty_state(spark, folder):
    assert ingest._folders(spark, f"{folder}/none", "batch") == {}
    assert issues.issue_flow_counts(rows(spark, 0).where(F.lit(False))).isEmpty()


def test_counts_are_merged_again_a_logarithmic_number_of_times(spark, folder, monkeypatch):
    path, merged, want = f"{folder}/counts", [], None
    whole = ingest._merged
    for batch in range(16):
        ingest.cell_counts(rows(spark, batch % 3)).write.parquet(f"{path}/batch={batch}")
        if batch and batch % 2 == 0:
            monkeypatch.setattr(ingest, "_merged", lambda s, folders: merged.append(list(folders)) or whole(s, folders))
            ingest.compact_counts(spark, path, batch)
            monkeypatch.setattr(ingest, "_merged", whole)
        want = rows(spark, batch % 3) if want is None else want.unionAll(rows(spark, batch % 3))
    # Merges of 2, 4, 2, 8, 2, 4 and 2 batches: 24, where merging all every time takes 56.
    spans = [last - first + 1 for first, last, _ in ingest._merges(spark, path)]
    assert spans == [2, 4, 8] and sum(len(m) for m in merged) == 18
    assert same(ingest.streamed_flows(spark, path), issues.issue_flow_counts(want))
    assert len(listed(spark, f"{path}/batch=*")) <= 4


def test_wide_counts_are_shuffled_once_into_tasks_of_bounded_bytes(spark, streamed, monkeypatch):
    path, _ = streamed
    monkeypatch.setattr(ingest, "TASK_BYTES", 64)
    for wide in (ingest.wide_counts(spark, path), ingest.streamed_flows(spark, path)):
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert wide.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
