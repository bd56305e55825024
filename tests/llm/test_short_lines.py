"""Short repeated lines in the line stage of the pipeline."""

import corpus_pipeline


def test_later_copies_of_short_lines_go(spark):
    rows = [(1, "a b\nc d\ne f\nown words"), (2, "new here\na b\nc d\ne f\n\nmore"), (3, "x\n\nc d"), (4, "c d"), (5, "字字字\n\ny"), (6, "z\n字字字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items()} == {
        1: ["a b", "c d", "e f", "own words"], 2: ["new here", "more"], 3: ["x"], 5: ["字字字", "y"], 6: ["z"]}
    assert got[2].split("\n") == ["new here", "", "more"]
