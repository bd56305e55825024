"""Work that does not hang on each other runs at the same time, with the same results."""

import threading

import pytest
from pyspark.ml.linalg import Vectors

from buildlode import schemas
from buildlode.plans import jobs, training
from buildlode.session import at_once
from buildlode.sources.ledger import LoadLedger
from buildlode.sources.sinks import Artefacts, ParquetResults
from test_learning import NAMES, assembled, cells_of, samples  # noqa: F401


@pytest.fixture()
def table(samples):  # noqa: F811
    return assembled(samples).selectExpr("cast(analysis_key AS string) AS row_key", "label", "features").cache()


def finish(spark, folder, table, mode):
    study = jobs.Study(spark, None, Artefacts(spark, f"{folder}/m"), ParquetResults(spark, f"{folder}/r"))
    tests = lambda: training.dense_tests(table.sparkSession.createDataFrame(
        [(r.label, Vectors.dense([v / 4 for v in r.features.toArray()])) for r in table.collect()], ["label", "features"]))
    jobs._finish(study, 1, mode, table, NAMES, tests)
    values = lambda t, names: sorted(tuple(map(str, r)) for r in study.results.table(t).select("model", *names).collect())
    return values("model_performance", schemas.METRICS), values("model_info", [f"train_{m}" for m in schemas.METRICS])


def test_both_sets_of_models_are_trained_at_once(spark, folder, table, monkeypatch):
    both, train = threading.Barrier(2, timeout=120), training.train

    def met(*args, **options):
        both.wait()  # Never passed by one after the other.
        return train(*args, **options)

    monkeypatch.setattr(training, "train", met)
    at_the_same_time = finish(spark, f"{folder}/a", table, "first")
    monkeypatch.setattr(training, "train", train)
    monkeypatch.setattr(jobs, "SIDE_BY_SIDE_ROWS", 0)
    assert at_the_same_time == finish(spark, f"{folder}/b", table, "first")
    assert [len(x) for x in at_the_same_time] == [6, 7]


def test_loads_entered_at_once_are_all_entered(spark, folder):
    ledger = LoadLedger(spark, folder)
    at_once(spark, *[lambda n=n: ledger.enter(f"load-{n}", "t") for n in range(8)])
    assert ledger.loads("t") == [f"load-{n}" for n in range(8)]


def test_outcomes_are_joined_once_for_totals_and_cells(spark, samples, monkeypatch):  # noqa: F811
    made, cut = [], training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df, label: made.append(label) or cut(df, label))
    known = cells_of(samples).select("analysis_key").distinct()
    tests = training.count_tests(cells_of(samples), samples.join(known, "analysis_key", "left_semi"))
    assert made == ["outcome-counts"]
    assert "LeftSemi" not in tests._jdf.queryExecution().executedPlan().toString()
