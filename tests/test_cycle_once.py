"""A cycle parses its staged files once, for the load, the marks and the archive."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildlode import session
from buildlode.plans import cycle
from buildlode.sources import staging
from buildlode.sources.store import RowStore
from test_ledger import TABLE, analyses, keys


def test_the_archive_takes_the_rows_of_the_load(spark, folder, monkeypatch):
    staged, root, archive, plans = f"{folder}/in", f"{folder}/t", f"{folder}/a", []
    merge = staging.merge_into_archive

    def seen(new, *args, **options):
        plans.append(new._jdf.queryExecution().executedPlan().toString())
        merge(new, *args, **options)

    monkeypatch.setattr(staging, "merge_into_archive", seen)
    left = set(os.listdir(session._test_dir()))
    # Copies inside a file; the second cycle has stored rows to leave out, the third no new one.
    for name, new in (("one", "aab"), ("two", "bcc"), ("three", "abc")):
        staging.staged_table_write(analyses(spark, *new), staged, TABLE, "o", name)
        cycle.run_cycle(spark, staged, root, archive, lambda t: None, [TABLE])
        assert staging.staged_files(spark, staged, TABLE) == []
    assert len(plans) == 3 and not any("csv" in p.lower() or "Exchange" in p for p in plans)
    assert keys(RowStore(spark, f"{archive}/{TABLE}").rows()) == keys(RowStore(spark, f"{root}/{TABLE}").rows()) == ["a", "b", "c"]
    assert RowStore(spark, f"{archive}/{TABLE}").rows().columns == analyses(spark).columns
    assert set(os.listdir(session._test_dir())) == left


def test_files_with_headers_alone_give_empty_rows(spark, folder):
    staged, path = f"{folder}/in", Path(f"{folder}/in/sonarcloud/o/analyses")
    path.mkdir(parents=True)
    (path / "x_staging.csv").write_text(",".join(analyses(spark).columns) + "\n")
    count = lambda t: t.table(TABLE).count()
    assert cycle.run_cycle(spark, staged, f"{folder}/t", f"{folder}/a", count, [TABLE]) == 0
    assert (path / "x.csv").exists()


def test_taken_rows_meet_an_archive_of_other_buckets_and_column_order(spark, folder):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    for n, order in enumerate((["a", "b"], ["b", "a"])):
        taken = RowStore(spark, f"{folder}/s{n}", buckets=4).take(rows, ["a", "b"], "load-1", more=F.lit(1))
        archive = RowStore(spark, f"{folder}/a{n}", buckets=7)
        archive.merge(spark.createDataFrame([(2, None), (3, "z")], "a int, b string").select(*order), "load-0")
        archive.merge(taken, "load-1", taken=True)
        again = RowStore(spark, f"{folder}/a{n}")
        assert sorted(r.a for r in again.rows().collect()) == [1, 2, 3]
        assert again.stored().where(f"bucket != pmod(row_hash, 7) OR row_hash != xxhash64({', '.join(order)})").isEmpty()


def test_calls_at_once_keep_their_order_and_their_block(spark):
    with session.intermediates(spark):
        made = session.at_once(spark, *[lambda n=n: session.cut_lineage(spark.range(n), "part") for n in (3, 1, 2)])
        with session.apart():
            kept = session.cut_lineage(spark.range(5), "kept")
        assert [df.count() for df in made] == [3, 1, 2]
    assert not any(os.path.exists(f.removeprefix("file:")) for df in made for f in df.inputFiles()) and kept.count() == 5

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        session.at_once(spark, fail, lambda: 1)
