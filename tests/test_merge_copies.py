"""Copies on the archive's own side of a merge."""

from buildlode.operators import delta


def test_merge_removes_copies_that_the_archive_already_holds(spark):
    archive = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    new = spark.createDataFrame([(None, 4), ("x", 2), (None, 4)], "b string, a int")
    got = delta.merge_dedup(new, archive)
    assert got.columns == ["a", "b"]
    assert sorted(map(str, got.collect())) == sorted(["Row(a=1, b=None)", "Row(a=2, b='x')", "Row(a=3, b='y')", "Row(a=4, b=None)"])
