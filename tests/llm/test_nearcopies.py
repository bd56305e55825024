"""Near copies at 0.8 of 5-word shingles against all pairs."""

import random

from brute import joined, similar_pairs
from pyspark.sql import functions as F

from buildlode.llm import nearcopies

SCHEMA = "doc_id long, text string, fp string, text_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def groups(df):
    return {r._doc: r.first._doc for r in nearcopies.near_copies(df).collect()}


def text(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def test_recall_over_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    pairs, first = similar_pairs(texts), groups(df)
    roots = joined(texts, pairs)
    assert all(roots[i] == roots[j] for i, j in first.items())
    near = [p for p in pairs if texts[p[0]] != texts[p[1]]]
    assert sum(first[a] == first[b] for a, b in near) >= 0.9 * len(near) > 5


def test_a_crowd_of_near_copies_is_one_group(spark):
    rnd = random.Random(1)
    base = text(rnd, 400)
    rows = [(0, " ".join(base))]
    for i in range(1, 800):
        own = list(base)
        for _ in range(6):  # copies are nearer to the first text than to one another
            own[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(text(rnd, 300))) for i in range(300)]
    first = groups(docs(spark, rows))
    assert sum(first[i] == 0 for i in range(800)) >= 0.95 * 800
    assert all(first[i] == i for i in range(1000, 1300))


def test_edges(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, "a c"), (7, long), (8, long + " end"), (None, "a b"), (9, "a b"), (9, "a b"), (9, "z")]
    first = groups(docs(spark, rows))
    assert {first[i] for i in (1, 2, 3)} == {1} and first[5] == first[4] == first[None] == 4
    assert first[6] == 6 and first[8] == 7
    kept = nearcopies.drop_near_copies(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "text_id"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (4, "a b"), (6, "a c"), (7, long), (9, "z")]
    empty = docs(spark, rows).where(F.lit(False))
    assert nearcopies.drop_near_copies(empty).collect() == []


def test_samples_keep_the_recall_at_every_size():
    for texts in (1, 1000, 10**6, 10**9):
        bits, count = nearcopies.samples(texts)
        assert 1 - (1 - (1 - nearcopies.DIFFERING) ** bits) ** count >= nearcopies.RECALL


def test_a_text_hidden_by_a_crowd_keeps_its_links(spark):
    rnd = random.Random(3)
    base, rows = text(rnd, 400), []
    for i in range(30):
        own = list(base)
        own[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(40):
        # The first is a near copy of the crowd, the second one of the first alone.
        low = 5 + 9 * rnd.randrange(20)
        own = list(base)
        own[low : low + 30] = [f"y{i}-{n}" for n in range(30)]
        rows.append((100 + 2 * i, " ".join(own)))
        own[low + 120 : low + 150] = [f"z{i}-{n}" for n in range(30)]
        rows.append((101 + 2 * i, " ".join(own)))
    texts = dict(rows)
    pairs, table = similar_pairs(texts), docs(spark, rows)
    assert all((100 + 2 * i, 101 + 2 * i) in pairs for i in range(40))
    # All pairs of a value within the radius, verified: nothing is left out.
    made = nearcopies.keyed(table).mapInArrow(nearcopies._prints(5), "_doc long, _text_hash long, fp long, sketch array<long>")
    dealt = nearcopies._dealt(made.select("_doc", "fp").localCheckpoint()).collect()
    prints, values = {r._doc: r.fp & (1 << 64) - 1 for r in dealt}, {}
    for r in dealt:
        values.setdefault(r._doc, set()).add(r.value)
    met = [(a, b) for a, b in pairs if values[a] & values[b] and (prints[a] ^ prints[b]).bit_count() <= nearcopies.RADIUS]
    assert groups(table) == joined(texts, met)


def test_crowded_values_are_compared_whole_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 7)
    monkeypatch.setattr(nearcopies, "STEP", 3)
    rnd = random.Random(5)
    near = [rnd.getrandbits(64)]
    near += [near[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(59)]
    signed = [v - (1 << 64) if v >> 63 else v for v in near]
    root = [rnd.randrange(4) for _ in near]
    texts = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(zip(signed, root))], "text_id long, fp long, root long")
    values = nearcopies._dealt(texts).select("value").distinct()
    shared = {}
    for r in nearcopies._dealt(texts).collect():
        shared.setdefault(r.value, []).append(r.text_id)
    want = {(a, b) for ids in shared.values() for a in ids for b in ids if a < b and root[a] != root[b] and (near[a] ^ near[b]).bit_count() <= 3}
    got = nearcopies.crowd_pairs(texts, values, radius=3).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50


def test_a_crowd_that_is_near_in_bits_alone_makes_no_rows_and_a_linked_one_a_forest(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", 6000)
    rnd = random.Random(7)
    base = rnd.getrandbits(63)
    rows = [(i, base ^ (1 << rnd.randrange(62)), i, i % 4) for i in range(480)]
    # Kind 0 shares half of its shingles, kind 1 nearly all; kinds 2 and 3 have none and one.
    common = sorted(rnd.randrange(1 << 62) for _ in range(40))
    own = {0: lambda i: sorted(common[:20] + [10**6 * i + n for n in range(20)]), 1: lambda i: sorted([*common, i]), 2: lambda i: [], 3: lambda i: [i]}
    sets = {i: own[kind](i) for i, _, _, kind in rows}
    texts = spark.createDataFrame([r[:3] for r in rows], "text_id long, fp long, root long")
    table = spark.createDataFrame(list(sets.items()), "text_id long, shingles array<long>")
    values = nearcopies._dealt(texts).select("value").distinct()
    got = [(r.a, r.b) for r in nearcopies.crowd_pairs(texts, values, 15, table, 0.8).collect()]

    def alike(a, b):
        return len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a], *sets[b]})

    assert all(alike(a, b) for a, b in got)
    shared = {}
    for r in nearcopies._dealt(texts).collect():
        shared.setdefault(r.value, []).append(r.text_id)
    want = {(a, b) for ids in shared.values() for a in ids for b in ids if a < b and alike(a, b)}
    names = {i: i for i in sets}
    assert joined(names, set(got)) == joined(names, want)
    assert len(got) < len(want) / 2
