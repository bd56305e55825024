"""Hadoop file system checks that work for local, HDFS and object-store paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path, which may hold globs, names at least one file or folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match the pattern, in order."""
    target, fs = _file_system(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(target) or ())


def move(spark: SparkSession, source: str, path: str) -> None:
    """Rename within one file system; what was at ``path`` is replaced."""
    old, fs = _file_system(spark, source)
    new, _ = _file_system(spark, path)
    fs.delete(new, True)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {path}")


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below the path."""
    target, fs = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def make_folder(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.mkdirs(target)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The path itself if it is a file, else the files below it that Spark reads; none is empty."""
    target, fs = _file_system(spark, path)
    out, open_folders = [], [target]
    while open_folders:
        for status in fs.listStatus(open_folders.pop()):
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith(("_", ".")):
                open_folders.append(status.getPath())
            elif status.isFile() and status.getLen() and (status.getPath() == target or not name.startswith(("_", "."))):
                out.append(status.getPath().toString())
    return sorted(out)


def first_line(spark: SparkSession, path: str) -> str:
    """First line of a text file; no more than its first block is read."""
    jvm = spark.sparkContext._jvm
    target, fs = _file_system(spark, path)
    raw = fs.open(target)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw, "UTF-8")).readLine() or ""
    finally:
        raw.close()
