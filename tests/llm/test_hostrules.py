"""Host rules against a plain count and hand-made hosts."""

import random

from pyspark.sql import functions as F

from buildlode.llm import hostrules


def plain(text):
    words = hostrules.WORD.findall(text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(lines)


def test_counts_equal_a_plain_count():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b ", " c", "é", "\n", "\t", "#", "a b c ", "\x0b", "\x85"]) for _ in range(rnd.randrange(60)))
        assert hostrules.text_counts(text) == plain(text), text


GOOD = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, host string, kept int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA)


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark):
    rows = [(i, GOOD, f"https://u@Good{i % 8}.org:8/{i}") for i in range(400)]
    rows += [(1000 + i, GOOD if i % 10 == 0 else "short", "http://bad.org/x") for i in range(100)]
    rows += [(2000, "short", "tiny")]
    got = {r.doc_id: r for r in hostrules.rule_report(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and got[9].host == "good1.org" and got[9].kept
    assert got[1000].host_rejected and not got[1000].base_failed and not got[1000].kept
    assert got[2000].base_failed and not got[2000].kept
    priors = hostrules.beta_priors(hostrules.host_failures(hostrules.document_counts(docs(spark, rows))))
    mean, strength = priors["base"]
    assert abs(mean - 91 / 501) < 1e-12 and 1 <= strength < 501
    assert priors["symbols"] == (0.0, 501.0)


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, GOOD, "h"), (4, "x " * 300_000, "h"), (5, GOOD, "://")]
    got = sorted(hostrules.rule_report(docs(spark, rows)).collect(), key=str)
    assert len(got) == 6
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[1, 0].host is None and by[1, 0].base_failed and not by[1, 0].host_rejected
    assert by[None, 60].kept and by[4, 300_000].n_repeat_words == 300_000 and not by[4, 300_000].kept
    empty = docs(spark, rows).where(F.lit(False))
    assert hostrules.rule_report(empty).collect() == []
