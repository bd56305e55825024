"""The registered reports of the jobs hold every metric."""

from buildlode import schemas
from buildlode.catalog import ORACLES, QUERIES

NAMES = ["job_ml1", "job_ml2", "job_ml3", "train_classifiers", "score_incremental", "run_all"]


def test_full_reports_are_registered_without_sql():
    assert all(f"{n}_report" in QUERIES and f"{n}_report" not in ORACLES for n in NAMES)


def test_a_report_holds_every_metric(spark):
    rows = QUERIES["job_ml1_report"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 6
    assert all(r[m] is None or 0 <= r[m] <= 1 for r in rows for m in schemas.METRICS)
    assert all(any(r[m] is not None for m in schemas.METRICS) for r in rows)
