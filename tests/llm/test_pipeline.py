"""The pipeline stage by stage against brute force on its own input."""

import pytest
from brute import contaminated, joined, kept_lines, similar_pairs
from compare import bag, duck

import corpus_pipeline
from buildlode.llm import nearcopies, quality
from buildlode.llm.queries import MIX_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before each stage and after the last, written as the check does."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for after in stages[1:-1]:
        assert after.columns == stages[0].columns


def test_quality_stage_follows_the_report(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    report = quality.quality_report(stages[0], labels).where("selected")
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in report.collect()}
    assert stages[1].count() > 0.7 * stages[0].count()


def test_line_stage(stages):
    kept = kept_lines({r.doc_id: r.text for r in stages[1].collect()}, min_words=1)
    want = {i: "\n".join(k) for i, (x, k) in kept.items() if k}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_duplicate_stage(stages):
    """Only texts that verified links join go, and at least nine of ten links are found."""
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    pairs = similar_pairs(texts)
    roots = joined(texts, pairs)
    kept = {r.doc_id for r in stages[3].collect()}
    first = {r._doc: r.first._doc for r in nearcopies.near_copies(stages[2]).collect()}
    assert kept == set(first.values())
    assert all(roots[i] == roots[j] for i, j in first.items())
    found = [first[a] == first[b] for a, b in pairs]
    assert sum(found) >= 0.9 * len(found)
    assert all(first[a] == first[b] for a, b in pairs if texts[a] == texts[b])


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[3].collect() if not contaminated(r.text, items)}
    assert {r.doc_id for r in stages[4].collect()} == want and want


def test_mixing_stage_and_run(spark, stages):
    con = duck(FOLDER)
    con.execute("DROP VIEW documents")
    files = [f.removeprefix("file://") for f in stages[4].inputFiles()]
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({files})")
    cur = con.execute(MIX_SQL)
    want = bag([c[0] for c in cur.description], cur.fetchall())
    assert bag(stages[5].columns, stages[5].collect()) == want
    ran = corpus_pipeline.run(spark, FOLDER)
    assert bag(ran.columns, ran.collect()) == want
