"""Trees of all projects: rows meet their features once, not at every level."""

from pyspark.sql import functions as F

from buildlode.operators import trees


def test_cells_are_read_once_and_splits_stay(spark, folder, monkeypatch):
    outcomes = spark.range(400).select(
        F.expr("if(id % 3 = 0, 'p', 'q')").alias("project"),
        F.concat(F.lit("a"), F.col("id") % 90).alias("analysis_key"),
        F.col("id").cast("string").alias("row_key"),
        F.expr("if(hash(id) % 3 = 0 OR id % 90 > 70, 1.0D, 0.0D)").alias("label"),
    )
    cells = outcomes.select("project", "analysis_key").distinct().selectExpr(
        "project", "analysis_key", "explode(sequence(0, 3)) AS slot"
    ).withColumn("n", F.abs(F.hash("analysis_key", "slot")) % 4).where("n > 0 AND analysis_key <> 'a7'")
    cells.withColumn("n", F.col("n").cast("long")).write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    reads, write = [], trees.cut_lineage

    def watched(df, label):
        reads.extend(f for f in df.inputFiles() if f"{folder}/cells" in f)
        return write(df, label)

    monkeypatch.setattr(trees, "cut_lineage", watched)
    rows = trees.single_tree_weights(outcomes, ["project"]).withColumn("tree", F.lit(trees.SINGLE))
    rows = rows.unionByName(trees.bootstrap_weights(outcomes, ["project"], 3, "row_key", 1))
    grown = trees.grow(rows, cells, ["project"], 3)
    assert len(reads) == len(set(reads))
    found = {(r.project, r.tree, r.node) for r in grown.collect()}
    assert {t for _, t, _ in found} == {trees.SINGLE, 0, 1, 2} and {n for _, _, n in found} == set(range(1, 8))
    # The weights of a child are those of the rows that a split sends to it.
    per = {(r.project, r.tree, r.node): r for r in grown.collect()}
    values = {(r.project, r.analysis_key, r.slot): r.n for r in cells.collect()}
    weights = {}
    for r in rows.collect():
        at = 1
        while (r.project, r.tree, at) in per:
            s = per[r.project, r.tree, at]
            weights[r.project, r.tree, at] = weights.get((r.project, r.tree, at), 0) + r.ok + r.failed
            at = at * 2 + (values.get((r.project, r.analysis_key, s.slot), 0) > s.cut)
    assert weights == {k: r.weight for k, r in per.items()}
