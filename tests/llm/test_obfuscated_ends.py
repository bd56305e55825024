"""Signs at the ends of words, words of signs, several separators between letters."""

import pyarrow as pa
import pytest

from buildlode.llm import toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


@pytest.mark.parametrize("given, restored", [
    ("an 1d107 here", "an idiot here"), ("w0rthl3$$", "worthless"), ("h4t3", "hate"), ("ki11 it", "kill it"), ("1d10t!!", "idiot!!"),
    ("an i  d  i  o  t here", "an idiot here"), ("i - d - i - o - t", "idiot"),
    ("for $5 and v2", "for $5 and v2"), ("them!! 100! $100 2024", "them!! 100! $100 2024"), ("wow! c++ #1", "wow! c++ #1"),
])
def test_signs_at_the_ends(restorer, given, restored):
    assert restorer.column(pa.array([given])).to_pylist() == [restored]


def test_words_of_signs_where_the_corpus_has_the_word(spark):
    docs = spark.createDataFrame([(1, "you ass a useless thing of an ass " * 50)], "doc_id long, text string")
    got = toxicity.Restorer(toxicity.character_model(docs)).column(pa.array(["you 4$$ thing", "us3l3$$ $5"]))
    assert got.to_pylist() == ["you ass thing", "useless $5"]
