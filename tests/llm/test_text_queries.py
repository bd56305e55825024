"""Text queries against their check SQL, or against the laws they must keep."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_all_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_equals_sql(spark, con, name):
    verdict = compare(spark, con, name, entry.queries()[name], SQL[name], FOLDER)
    assert verdict.startswith("OK"), verdict
