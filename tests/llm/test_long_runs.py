"""Runs of one kind in very long texts: time grows with the text, readings stay."""

import time

import pyarrow as pa
import pytest

from buildlode.llm import toxicity

RUNS = {
    "signs": lambda n: "#" * n,
    "zeros": lambda n: "x" + "0" * n,
    "digits": lambda n: "1234567890" * (n // 10),
    "letters": lambda n: "abcdefghij" * (n // 10),
    "one letter": lambda n: "z" * n,
    "spaced letters": lambda n: "a b c d e " * (n // 10),
    "base64": lambda n: "Ab3dEf+9" * (n // 8),
    "separators": lambda n: "a" + "-" * n + " b",
}


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


@pytest.mark.parametrize("kind", RUNS)
def test_search_reads_a_text_once(kind):
    text = "see v2 here " + RUNS[kind](1_000_000) + " é and an 1d10t"
    begin = time.perf_counter()
    assert [m[0] for m in toxicity.SUSPECT.finditer(text)][-1] == "1d10t"
    assert time.perf_counter() - begin < 2


@pytest.mark.parametrize("kind", RUNS)
def test_long_runs_are_decoded_in_linear_time(restorer, kind):
    def seconds(n):
        text = "see v2 here " + RUNS[kind](n) + " and here"
        begin = time.perf_counter()
        got = restorer.column(pa.array([text])).to_pylist()[0]
        assert got.startswith("see v2 here ") and got.endswith(" and here")
        return time.perf_counter() - begin

    small, large = seconds(10_000), seconds(40_000)
    assert large < 8 * small + 1


def test_runs_without_a_reading_stay(restorer):
    text = "a rule " + "#" * 5_000 + " and 1" + "0" * 5_000 + " stay"
    assert restorer.column(pa.array([text])).to_pylist() == [text]
