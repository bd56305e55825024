"""Small helpers around the SparkSession: settings, shared folder, size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A side may be broadcast only after it was counted to hold no more rows.
BROADCAST_ROWS = 100_000


class _Made(list):
    """Paths made inside a block and the list of the block around it."""

    outer: _Made | None = None


_MADE: ContextVar[_Made | None] = ContextVar("made", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on; cluster sizing is left alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A recursive query over landed data may find more than the default million rows.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    # Tables are written once or twice and read by column: smaller files cost less than they save.
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    # Shuffle files go with their query, not with some later collection of garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # The JVM never compiles methods over 8,000 bytes; wide rows then run in smaller ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


@cache
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="buildlode-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the cluster's shared checkpoint folder.

    The folder is ``spark.checkpoint.dir`` of the session. Only a session that runs in
    one process may leave it unset: it gets a temporary folder. On a cluster that would
    be another disk for every executor, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _test_dir()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession, keep: str = ""):
    """Deletes the shared-folder tables made inside the block when it ends.

    Nothing that is still to be computed from them may leave the block, but for the
    tables labelled ``keep``.
    """
    made = _Made()
    made.outer = _MADE.get()
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            if keep and path.rpartition("/")[2].startswith(f"{keep}-"):
                continue
            target = hadoop.Path(path)
            target.getFileSystem(conf).delete(target, True)


@contextmanager
def apart():
    """Tables made inside the block do not belong to the nearest ``intermediates`` around it."""
    made = _MADE.get()
    token = _MADE.set(made.outer if made is not None else None)
    try:
        yield
    finally:
        _MADE.reset(token)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between the rounds of an iterative job: the plan stays short and a lost
    executor costs a file read, not a recomputation of all earlier rounds.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *calls: Callable[[], object]) -> list:
    """Results of calls that do not hang on each other, in order.

    Their Spark jobs share the executors, so the last tasks of one do not leave the others
    waiting. All have ended when this returns or raises what the first failing one raised.
    """
    with ThreadPoolExecutor(max(len(calls), 1)) as pool:
        running = [pool.submit(copy_context().run, inheritable_thread_target(spark)(call)) for call in calls]
    return [r.result() for r in running]


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` was counted to hold at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows
