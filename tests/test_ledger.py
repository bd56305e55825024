"""The store by row hash and the ledger of loads."""

import pytest
from pyspark.sql import functions as F

from buildlode.plans import cycle
from buildlode.sources import staging
from buildlode.sources.ledger import LedgerTables, LoadLedger
from buildlode.sources.store import RowStore

TABLE = "sonar_analyses"


def analyses(spark, *keys):
    rows = [("o", "p", k, None, None, f"r{k}") for k in keys]
    return spark.createDataFrame(rows, "organization string, project string, analysis_key string, date timestamp_ntz, project_version string, revision string")


def keys(df):
    return sorted(r.analysis_key for r in df.collect())


def test_store_keeps_each_row_once_with_nulls_and_float_zeros(spark, folder):
    store = RowStore(spark, f"{folder}/s", buckets=4)
    rows = spark.createDataFrame([(1, None), (1, None), (2, 0.0), (2, -0.0), (3, float("nan"))], "a int, b double")
    store.merge(rows, "load-1")
    store.merge(rows.unionAll(spark.createDataFrame([(None, None), (3, 1.0)], "a int, b double")), "load-2")
    assert store.rows().count() == 5 and store.rows().columns == ["a", "b"]
    assert RowStore(spark, f"{folder}/s", buckets=99).buckets == 4


def test_hash_collisions_are_compared_column_by_column(spark, folder, monkeypatch):
    from buildlode.operators import delta
    from buildlode.sources import store as module

    monkeypatch.setattr(module, "row_hash", lambda columns: F.lit(7).cast("long"))
    store = RowStore(spark, f"{folder}/s")
    store.merge(spark.createDataFrame([(1,), (2,)], "a int"), "load-1")
    store.merge(spark.createDataFrame([(2,), (3,)], "a int"), "load-2")
    assert sorted(r.a for r in store.rows().collect()) == [1, 2, 3]
    assert delta.HASH_ROWS > 0


def test_a_load_reads_only_its_buckets_and_shuffles_no_stored_row(spark, folder):
    store = RowStore(spark, f"{folder}/s", buckets=64)
    store.merge(spark.range(5000).withColumn("b", F.col("id") % 7), "load-1")
    load = store.placed(spark.range(3).withColumn("b", F.col("id") % 7), ["id", "b"])
    touched = {r.bucket for r in load.select("bucket").collect()}
    old = store.touched(load)
    files = {f.rpartition("/bucket=")[2].partition("/")[0] for f in old.select("row_hash").where(F.lit(True)).inputFiles()}
    plan = old.join(F.broadcast(load.select("row_hash")), "row_hash", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "Exchange hashpartitioning" not in plan and len(touched) <= 3 and files


def test_rows_of_an_unentered_load_do_not_count(spark, folder):
    ledger = LoadLedger(spark, folder)
    # A load that failed after its rows were written, before it was entered.
    staging.append_load(analyses(spark, "a", "b"), f"{folder}/{TABLE}", TABLE)
    assert LedgerTables(ledger).table(TABLE).count() == 0
    staging.append_load(analyses(spark, "b", "c"), f"{folder}/{TABLE}", TABLE, ledger)
    assert keys(LedgerTables(ledger).table(TABLE)) == ["b", "c"]
    staging.append_load(analyses(spark, "a", "c"), f"{folder}/{TABLE}", TABLE, ledger)
    assert keys(LedgerTables(ledger).table(TABLE)) == ["a", "b", "c"]


def test_loads_in_a_run_stay_new_and_unfinished_runs_count_for_nothing(spark, folder):
    ledger, path = LoadLedger(spark, folder), f"{folder}/{TABLE}"
    staging.append_load(analyses(spark, "a"), path, TABLE, ledger)
    run = ledger.begin()
    staging.append_load(analyses(spark, "b"), path, TABLE, ledger)
    assert keys(LedgerTables(ledger, run).table(TABLE)) == ["a"]
    assert keys(LedgerTables(ledger).table(TABLE).where("NOT processed")) == ["a", "b"]
    ledger.finish(run)
    ledger.begin()
    now = LedgerTables(ledger).table(TABLE)
    assert keys(now.where("NOT processed")) == ["b"] and keys(now.where("processed")) == ["a"]
    # The flag hangs on the load folder: the scan of new rows leaves out what was read.
    plan = now.where("NOT processed")._jdf.queryExecution().executedPlan().toString()
    assert "load_id" in plan.partition("PartitionFilters")[2].partition("]")[0]


def test_a_file_staged_while_models_run_is_neither_lost_nor_archived(spark, folder):
    staged, root, archive = f"{folder}/in", f"{folder}/t", f"{folder}/a"
    put = lambda k: staging.staged_table_write(analyses(spark, k), staged, TABLE, "o", k)
    put("a")

    def models(tables):
        put("b")
        return keys(tables.table(TABLE).where("NOT processed"))

    run = lambda f: cycle.run_cycle(spark, staged, root, archive, f, [TABLE])
    assert run(models) == ["a"]
    assert len(staging.staged_files(spark, staged, TABLE)) == 1 and keys(RowStore(spark, f"{archive}/{TABLE}").rows()) == ["a"]

    def failing(tables):
        raise RuntimeError("no models today")

    with pytest.raises(RuntimeError):
        run(failing)
    seen = lambda t: keys(t.table(TABLE).where("NOT processed"))
    assert run(seen) == ["b"] and run(seen) == []
    assert keys(RowStore(spark, f"{archive}/{TABLE}").rows()) == ["a", "b"]


def test_a_cycle_without_files_has_empty_tables(spark, folder):
    count = lambda t: t.table(TABLE).count()
    assert cycle.run_cycle(spark, f"{folder}/in", f"{folder}/t", f"{folder}/a", count, [TABLE]) == 0


def test_a_first_load_is_shuffled_once_and_written_once(spark, folder, monkeypatch):
    from buildlode.sources import store as module

    made = []
    monkeypatch.setattr(module, "cut_lineage", lambda df, label: made.append(label) or df)
    store = RowStore(spark, f"{folder}/s", buckets=4)
    new = spark.range(1000).selectExpr("id % 400 AS a", "concat('x', id % 400) AS b")
    rows = store.unstored(new, ["a", "b"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert made == [] and plan.count("Exchange") == 1
    store.merge(new, "load-1")
    assert made == [] and store.rows().count() == 400
    # Every bucket lies in the file of one task or a few, not in one of each.
    assert len(store.stored().inputFiles()) <= 4 * 16
