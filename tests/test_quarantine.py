"""Bad staged rows are set aside and counted; headers come from the first bytes."""

import datetime as dt
import os

import pytest

from buildlode.plans import cycle
from buildlode.sources import staging

TABLE = "sonar_analyses"
HEADER = "organization,project,analysis_key,date,project_version,revision"


def write(folder, name, text):
    os.makedirs(f"{folder}/sonarcloud/o/analyses", exist_ok=True)
    with open(f"{folder}/sonarcloud/o/analyses/{name}_staging.csv", "w") as f:
        f.write(text)


def split(spark, folder):
    files = staging.staged_files(spark, f"{folder}/in", TABLE)
    return staging.staged_csv_split(spark, files, TABLE, f"{folder}/rejects")


def test_bad_cells_and_bad_rows_go_aside_once(spark, folder):
    write(f"{folder}/in", "a", f'{HEADER}\no,p,k1,2020-01-01 00:00:00,"1\n2",r\no,p,k2,yesterday,v,r\no,p,k3\no,p,k4,,v,r\no,p,k5,2020-01-02 00:00:00,v,r,more\n')
    write(f"{folder}/in", "b", "revision,date,organization,project,analysis_key,project_version,x\nr, ,o,p,k6,v,z\n")
    write(f"{folder}/in", "empty", "")
    for _ in range(2):
        good = {r.analysis_key: r for r in split(spark, folder).collect()}
    assert set(good) == {"k1", "k4", "k6"} and good["k1"].project_version == "1\n2" and good["k4"].date is None
    counts = {r.problem: r.n for r in staging.reject_counts(spark, f"{folder}/rejects", TABLE).collect()}
    assert counts == {"date": 1, "cells": 2}
    records = [r.record for r in spark.read.parquet(f"{folder}/rejects/{TABLE}").collect()]
    assert any("yesterday" in r for r in records) and "o,p,k3" in records


def test_nothing_bad_leaves_no_reject(spark, folder):
    write(f"{folder}/in", "a", f"{HEADER}\no,p,k1,2020-01-01 00:00:00,v,r\n")
    assert split(spark, folder).count() == 1
    assert staging.reject_counts(spark, f"{folder}/rejects", TABLE).count() == 0


def test_a_missing_column_is_loud_all_the_same(spark, folder):
    write(f"{folder}/in", "a", "organization,project\no,p\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        split(spark, folder)


def test_a_cycle_sets_bad_rows_aside_or_stops_before_it_stores(spark, folder):
    write(f"{folder}/in", "a", f"{HEADER}\no,p,k1,2020-01-01 00:00:00,v,r\no,p,k2,never,v,r\n")
    seen = lambda t: [(r.analysis_key, r.date) for r in t.table(TABLE).collect()]
    run = lambda **options: cycle.run_cycle(spark, f"{folder}/in", f"{folder}/t", f"{folder}/a", seen, [TABLE], **options)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run()
    assert run(rejects=f"{folder}/rejects") == [("k1", dt.datetime(2020, 1, 1))]
    assert [r.n for r in staging.reject_counts(spark, f"{folder}/rejects", TABLE).collect()] == [1]


def test_only_rejected_rows_are_kept_as_text(spark, folder):
    write(f"{folder}/in", "a", f"{HEADER}\no,p,k1,2020-01-01 00:00:00,v,r\no,p,k2,never,v,r\n")
    read = staging._typed(spark, staging.staged_files(spark, f"{folder}/in", TABLE), TABLE, lenient=True)
    records = {r.analysis_key: r.record for r in read.collect()}
    assert records["k1"] is None and "never" in records["k2"]
