"""Every named query against its check SQL on the small data folder."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from buildlode.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Whole jobs, run by test_learning.py or covered by another job's query.
LONG = {"job_ml1", "job_ml2", "job_ml3", "train_classifiers", "score_incremental", "run_all", "issue_impact_by_project"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LONG])
def test_query(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert verdict.startswith("OK" if name in ORACLES else "ROWS"), verdict


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
