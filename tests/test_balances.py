"""Running totals kept in steps against the whole computation."""

import datetime as dt
import random

from pyspark.sql import functions as F

from buildlode import schemas
from buildlode.operators import issues
from buildlode.sources.balances import BalanceStore


def flows(spark, rows):
    base = spark.createDataFrame(rows, "project string, analysis_key string, date timestamp_ntz, up long, down long")
    first = {schemas.INTRODUCED[0]: "up", schemas.REMOVED[3]: "down"}
    return base.select("project", "analysis_key", "date", *[F.col(first.get(c, F.lit(0).cast("long"))).alias(c) if c in first else F.lit(0).cast("long").alias(c) for c in schemas.FLOW_COUNTS])


def drawn(rnd, n):
    date = lambda: rnd.choice([None, dt.datetime(2020, rnd.randrange(1, 13), rnd.randrange(1, 4), rnd.randrange(3))])
    return [(rnd.choice(["p", "q", None]), f"a{rnd.random()}", date(), rnd.randrange(9), rnd.randrange(9)) for _ in range(n)]


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_steps_equal_the_whole_with_late_and_missing_dates(spark, folder):
    rnd, store, everything = random.Random(4), BalanceStore(spark, folder), []
    for step in range(4):
        rows = drawn(rnd, 25)
        everything += rows
        for _ in range(2 if step == 2 else 1):
            store.step(flows(spark, rows), step)
    whole = flows(spark, everything)
    assert same(store.running_issue_totals(whole), issues.running_issue_totals(whole))


def test_a_step_reads_and_writes_only_from_its_first_day(spark, folder):
    store, day = BalanceStore(spark, folder), lambda m, n: dt.datetime(2020, m, n)
    store.step(flows(spark, [("p", "a", day(1, 1), 5, 0), ("p", "b", day(3, 1), 1, 0), ("p", "c", day(5, 1), 2, 0), ("q", "d", day(1, 1), 7, 0)]), 0)
    store.step(flows(spark, [("p", "e", day(3, 2), 1, 0)]), 1)
    written = spark.read.parquet(f"{folder}/days").where("step = 1").select("project", "day", schemas.CURRENT[0]).collect()
    assert {(r[0], r[1].month, r[2]) for r in written} == {("p", 3, 7), ("p", 5, 9)}
    totals = {(r.project, r.date): r[schemas.CURRENT[0]] for r in store.totals().collect()}
    assert totals == {("p", day(1, 1)): 5, ("p", day(3, 1)): 6, ("p", day(3, 2)): 7, ("p", day(5, 1)): 9, ("q", day(1, 1)): 7}


def test_an_empty_step_changes_nothing(spark, folder):
    store, rows = BalanceStore(spark, folder), flows(spark, [("p", "a", None, 1, 2)])
    store.step(rows, 0)
    store.step(rows.where(F.lit(False)), 1)
    assert same(store.running_issue_totals(rows), issues.running_issue_totals(rows))
