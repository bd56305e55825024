"""Run every named query on Spark and its check SQL on DuckDB and compare the rows.

Usage: python tests/compare.py <data folder> [query ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def canonical(value):
    if isinstance(value, (dt.datetime, dt.date, bool)) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return repr(value) if isinstance(value, str) else str(value)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = f"{time.time() - start:6.2f}s {len(rows):>8} rows"
    if sql is None:
        return f"ROWS  {took}"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {took} {sorted(set(names) ^ set(df.columns))}"
    got, want = bag(df.columns, rows), bag(names, expected)
    if got == want:
        return f"OK    {took}"
    extra, lost = next(iter((got - want).items()), None), next(iter((want - got).items()), None)
    return f"DIFF  {took} expected {len(expected)}\n   got  {str(extra)[:700]}\n   want {str(lost)[:700]}"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            verdict = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {str(e)[:900]}"
        print(f"{name:34s} {verdict}", flush=True)
