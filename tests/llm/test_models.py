"""Learned operators on held-out rows, and parts against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components as brute_components
from brute import fingerprint
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlode.llm import components, kernels, langid, pseudolm, quality, simhash, sketch, toxicity

FOLDER = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def area(label, score):
    rank = np.argsort(np.argsort(score))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


def test_simhash_equals_all_pairs(spark):
    got = {r.doc_id: r for r in entry.queries()["op7_simhash"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in texts}
    roots = brute_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_links_of_large_values_over_several_trees(spark):
    # Dense families of fingerprints, so that block values hold many and trees are split.
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(4)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(16)) for b in bases for _ in range(90)}
    ids = dict(enumerate(sorted(prints)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in ids.values()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), tree=8)
    roots = {r.node & (2**64 - 1): r.root for r in components.components(edges).collect()}
    want = brute_components(ids)
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(ids[i])
    got = {}
    for p in prints:
        got.setdefault(roots.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(500)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        for radius in (0, 1, 2, 3):
            found = sorted(tree.values[n] for n in tree.within(q, radius))
            assert found == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(chain.union(spark.createDataFrame([(900, 901)], "a long, b long"))).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(301)} | {(900, 900), (901, 900)}


def test_membership_misses_nothing(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = sketch.membership(rows, "h")
    hashes = np.array([r.h for r in rows.collect()]).view(np.uint64)
    assert len(sketch.maybe(bits, hashes)) == 5000
    assert len(sketch.maybe(bits, kernels.mix(hashes, 1))) < 50


def test_words_of_a_buffer_equal_split():
    texts = ["a bc\td", "", None, "  x ", "é è\n\nç", "y"]
    for _, data, offsets in kernels.buffers(pa.array(texts), chunk=4):
        starts, ends, first = kernels.spans(data, offsets, kernels.NOT_SPACE)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            own = raw[offsets[i] : offsets[i + 1]]
            assert [raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == own.split()
    assert kernels.hash_words(np.frombuffer(b"ab ab", np.uint8), np.array([0, 3]), np.array([2, 5])).tolist()[0] == \
        kernels.hash_words(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist()[0]


def test_quality_on_held_out_rows(spark):
    found = entry.queries()["op3_quality"](spark, FOLDER).join(table(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert area(found.quality.to_numpy(), found.p_tail.to_numpy()) > 0.95
    good = found[found.quality == 1]
    assert good.selected.mean() > 0.97


def test_ordinal_thresholds_rise_and_tails_fall():
    rng = np.random.default_rng(1)
    given = rng.integers(0, 4, 400)
    texts = [" ".join(["low", "mid", "high", "top"][g] for _ in range(5)) + f" {i}" for i, g in enumerate(given)]
    model = quality.fit(pa.array(texts), given)
    assert (np.diff(model.thresholds) > 0).all()
    scores = quality._sums(pa.array(texts), model.weights)
    tails = np.stack([model.tail(scores, g) for g in range(5)])
    assert (np.diff(tails, axis=0) <= 0).all() and (tails[0] == 1).all() and (tails[4] == 0).all()
    assert np.corrcoef(model.expected(scores), given)[0, 1] > 0.9


def test_language_on_held_out_rows(spark):
    found = entry.queries()["op8_language_id"](spark, FOLDER).join(table(spark, "documents").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.99


def test_forward_sums_all_segmentations():
    pieces = sorted({b" ", b"a", b"b", b" a", b"ab", b"b ", b" ab"})
    p = np.random.default_rng(2).random(len(pieces))
    by = dict(zip(pieces, p))

    def total(word):
        return 1.0 if not word else sum(by[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in by)

    words = [b" ab", b" abab", b" bba"]
    ends = np.cumsum([len(w) for w in words])
    lattice = langid.Lattice(langid.Pieces.of(pieces), np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert lattice.totals(p).tolist() == pytest.approx([total(w) for w in words])
    use = lattice.expected(p, np.ones(3))
    eps = 1e-6  # expected uses are the slope of the log probability in log p
    for i in range(len(p)):
        q = p.copy()
        q[i] *= 1 + eps
        slope = (np.log(lattice.totals(q)).sum() - np.log(lattice.totals(p)).sum()) / eps
        assert use[i] == pytest.approx(slope, abs=1e-4)


def test_toxicity_of_held_out_rows(spark):
    # Toxic English texts are marked by their words; the other languages' labels here are not.
    found = entry.queries()["op4_toxicity"](spark, FOLDER).join(table(spark, "labels"), "doc_id")
    held = found.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang = 'en'").toPandas()
    assert area(held.toxic.to_numpy(), held.score.to_numpy()) > 0.95


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.character_model(table(spark, "documents"))


@pytest.mark.parametrize("given, restored", [
    ("you $tup1d thing", "you stupid thing"), ("an i d i o t here", "an idiot here"), ("a cloooown", "a clown"),
    ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("p@th3tic", "pathetic"), ("s.c.u.m", "scum"),
    ("nothing to do, 12 of them!!", "nothing to do, 12 of them!!"),
])
def test_deobfuscation(characters, given, restored):
    assert toxicity.Restorer(characters).text(given) == restored


def test_obfuscated_texts_score_like_plain_ones(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    more = spark.createDataFrame([(10**6, "the idiot and the moron"), (10**6 + 1, "the 1d!ot and the m o r o n")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text").union(more), labels).where("doc_id >= 1000000").collect()}
    assert got[10**6].predicted == got[10**6 + 1].predicted == 1


def test_pseudo_likelihood_beats_token_frequencies(spark):
    docs = table(spark, "documents")
    model = pseudolm.train(docs)
    total = pseudolm.score(docs, model).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    counts = np.zeros(pseudolm.TOKENS)
    for _, _, h in pseudolm._hashes(pa.array([r.text for r in docs.select("text").collect()])):
        counts += np.bincount(model.tokens(h), minlength=pseudolm.TOKENS)
    p = counts[counts > 0] / counts.sum()
    assert total > (p * np.log(p)).sum()
    # Every word of the longest text has a finite score.
    text = docs.orderBy("n_chars", ascending=False).first().text
    scorer = pseudolm.Scorer(model)
    (_, first, h), = list(pseudolm._hashes(pa.array([text])))
    logs = scorer(first, h)
    assert np.isfinite(logs).all() and (logs < 0).all()
