"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from buildlode.llm import (
    decontaminate,
    exact,
    langid,
    lines,
    mixing,
    pseudolm,
    quality,
    simhash,
    substrings,
    toxicity,
)

ITEM = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, f"Start {ITEM} end of it", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \t\n ", "en", "b"),
    (5, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (7, "twin text of some words\nand a second line of it here", "en", "a"),
    (7, "twin text of some words\nand a second line of it here", "en", "a"),
    (7, "another text under the same number", "fr", "a"),
    (None, f"no number {ITEM}", "fr", "c"),
    (None, None, None, None),
    (8, "\U0001f600 !!! 123", "fr", "c"),
]
CLASH = ["_doc", "_text_hash", "row", "key", "at", "size", "score", "p_tail", "fp", "rank", "words", "n_words", "name"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return made.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (4, 0, None), (5, None, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, ITEM), (None, ITEM), (3, None), (4, ""), (5, "same number"), (5, "absent words")], "item_id long, text string"
    )


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    out = {}
    for r in rows_of(df):
        out.setdefault(r["doc_id"], []).append(r)
    return out


def word_scores(docs):
    counts = pseudolm.word_counts(docs)
    return pseudolm.score_words(docs, pseudolm.train(docs, counts), counts)


REPORTS = {
    "decontaminate": lambda d, l, i: decontaminate.decontamination_report(d, i),
    "mix": lambda d, l, i: mixing.mix(d),
    "quality": lambda d, l, i: quality.quality_report(d, l),
    "toxicity": lambda d, l, i: toxicity.score(d, l),
    "substrings": lambda d, l, i: substrings.remove_repeated(d),
    "pseudolm": lambda d, l, i: pseudolm.score(d, pseudolm.train(d)),
    "pseudolm words": lambda d, l, i: word_scores(d),
    "simhash": lambda d, l, i: simhash.simhash_components(d),
    "langid": lambda d, l, i: langid.language_report(d),
    "exact": lambda d, l, i: exact.exact_duplicates(d),
    "lines": lambda d, l, i: lines.line_report(d),
}
FILTERS = {
    "decontaminate": lambda d, l, i: decontaminate.decontaminate(d, i),
    "quality": lambda d, l, i: quality.select(d, l),
    "lines": lambda d, l, i: lines.dedup_lines(d),
    "simhash": lambda d, l, i: simhash.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_document(docs, labels, items, name):
    found = REPORTS[name](docs, labels, items).cache()
    assert sorted(str(r["doc_id"]) for r in rows_of(found)) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables(docs, labels, items, name):
    assert REPORTS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["decontaminate", "quality", "toxicity"])
def test_empty_side_tables(docs, labels, items, name):
    assert REPORTS[name](docs, labels.limit(0), items.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(docs, labels, items, name):
    kept = FILTERS[name](docs, labels, items)
    assert kept.schema.names == docs.schema.names
    got = rows_of(kept)
    assert got and all(r[c] == "x" for r in got for c in CLASH)
    assert FILTERS[name](docs.limit(0), labels, items).count() == 0


def test_contamination(docs, items):
    got = by_id(decontaminate.decontamination_report(docs, items))
    assert [got[1][0][c] for c in ("n_words", "n_hit", "n_items", "contaminated")] == [16, 12, 2, True]
    assert got[None][0]["n_hit"] + got[None][1]["n_hit"] == 12
    assert got[2][0]["n_words"] == got[3][0]["n_words"] == 0 and not got[2][0]["contaminated"]
    assert [r["n_hit"] for r in got[7]] == [2 if "same" in "another text under the same number" and r["n_hit"] else 0 for r in got[7]]


def test_mix_takes_at_most_three_times(docs):
    got = rows_of(mixing.mix(docs))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sources = {(r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in sources) - sum(r["size"] for r in got)) < 1
    again = rows_of(mixing.mix(docs.repartition(5)))
    order = lambda rows: sorted(map(str, rows))
    assert order(got) == order(again)


def test_exact_groups(docs):
    got = by_id(exact.exact_duplicates(docs))
    assert [r["group_size"] for r in got[2]] == [3] and got[2][0]["kept"]
    assert not got[3][0]["kept"] and got[4][0]["group_size"] == 1  # white space alone is one space
    assert got[6][0]["keep_id"] == 5 and got[5][0]["kept"]
    assert sorted((r["group_size"], r["kept"]) for r in got[7]) == [(1, True), (2, False), (2, True)]


def test_substring_removal(docs):
    got = by_id(substrings.remove_repeated(docs))
    assert got[5][0]["n_removed"] == 0 and got[6][0]["n_removed"] == 60_000
    assert got[6][0]["kept_text"] == "" and got[2][0]["n_words"] == 0


def test_line_removal(docs):
    got = by_id(lines.line_report(docs))
    assert got[6][0]["n_removed"] == 1 and got[5][0]["n_removed"] == 0
    assert got[2][0]["n_lines"] == 1 and got[2][0]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in got[7])  # rows of one document do not remove each other


def test_simhash_of_texts_without_words(docs):
    got = by_id(simhash.simhash_components(docs))
    assert {got[i][0]["component_id"] for i in (2, 3, 4)} == {2}
    assert got[2][0]["fingerprint"] == "0" * 16
    assert got[6][0]["component_id"] == 5


def test_language_of_texts_without_letters(docs):
    got = by_id(langid.language_report(docs))
    assert all(got[i][0]["lang_pred"] == "und" for i in (2, 3, 4, 8))
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)


def test_scores_are_probabilities(docs, labels):
    for r in rows_of(toxicity.score(docs, labels)):
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    for r in rows_of(quality.quality_report(docs, labels)):
        assert 0 <= r["p_tail"] <= 1 and 0 <= r["expected_grade"] <= 2
    for r in rows_of(pseudolm.score(docs, pseudolm.train(docs))) + rows_of(word_scores(docs)):
        assert r["log_likelihood"] <= 0 and (r["n_tokens"] > 0 or r["mean_log_likelihood"] is None)
