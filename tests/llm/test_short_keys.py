"""Keys of few bits clash; names stay exact and the search for keys ends."""

from buildlode.llm import exact, lines
from buildlode.llm.common import keyed
from buildlode.llm.naming import proven_keys


def test_keys_of_8_bits_grow_until_they_differ(spark):
    values = spark.range(3_000).selectExpr("concat('line ', id div 2) AS x")
    width, keys = proven_keys(values, "keys", bits=8)
    assert width > 2
    assert {r.n for r in keys.collect()} == {2} and keys.distinct().count() == 1_500


def test_groups_do_not_hang_on_the_bits(spark):
    texts = [f"text {i % 40} " + "abcdefgh" * (i % 40) for i in range(120)] + ["", None, "x" * 5_000, "x" * 5_000, "x" * 4_999]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {}
    for r in exact.document_names(docs, block=4, bits=8).collect():
        names.setdefault((r.blocks, r.name), []).append(r.doc_id)
    want = {}
    for i, text in enumerate(texts):
        want.setdefault(text or "", []).append(i)
    assert sorted(sorted(v) for v in names.values()) == sorted(want.values())


def test_line_runs_do_not_hang_on_the_bits(spark):
    texts = ["\n".join(f"line {(i * j) % 300} of some few words" for j in range(i % 7 + 2)) for i in range(200)]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = [sorted(lines.later_copies(docs, bits=bits).select("_doc", "at", "length").collect()) for bits in (8, 64)]
    assert found[0] and found[0] == found[1]
