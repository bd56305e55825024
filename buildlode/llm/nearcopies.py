"""Near copies at a given share of word shingles: SimHash candidates, exact verification.

Texts are fingerprinted over 5-word shingles. Two texts that share 0.8 of their shingles
differ in about 15 of 100 fingerprint bits, too many for blocks that must agree as a
whole; so fingerprints are dealt out by the values of many samples of bits, as many as
bring ``RECALL`` of such pairs together in one sample or more. The fingerprints of a value
are searched in a BK-tree within ``RADIUS``. A text that has ``CROWD`` neighbours in the
tree already is not filed itself, so a group of thousands of near copies costs no more
than its size; it is linked to those neighbours. Candidates are then verified by the exact
share of shingles, and only verified links join texts. What a crowd left out is made good
exactly: in a value that had one, all pairs within ``RADIUS`` whose texts are not joined yet
are verified too, so every such pair of a value is either verified or joined without it.
These are verified where they meet, and a task returns a forest of links: the pairs of a
crowd, as many as its square, are compared in blocks but never become rows.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small
from . import kernels as K
from .common import KEY, PLAIN, cut_lineage, join_key, keyed, plain_key, spread, wrapped
from .components import components
from .simhash import BKTree

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which linked fingerprints may differ, and the share of bits that differ between
#: texts of that similarity: the angle of two sets of equal size, over pi.
RADIUS = 15
DIFFERING = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
RECALL = 0.95
CROWD = 4
#: Least hashes kept of each text. Unrelated candidates are told by them and need no text:
#: a pair goes if they estimate under half the similarity, six deviations below it.
SKETCH = 32
#: Texts of a crowded value that are compared at once with as many others, a step of these,
#: and shingles after which a block ends where they are compared whole.
BLOCK, STEP, BLOCK_SHINGLES = 4096, 128, 1 << 20


def samples(texts: int) -> tuple[int, int]:
    """Bits of a sample and number of samples for so many distinct texts.

    A value holds four unrelated texts on average, whatever their number; the samples grow
    so that the recall stays.
    """
    bits = max(12, math.ceil(math.log2(max(texts, 1))) - 2)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFERING) ** bits))


def _masks(bits: int, count: int) -> list[int]:
    """Random samples of bits, as signed 64-bit integers; the same in every run."""
    rnd = random.Random(20_250_101)
    masks = [sum(1 << b for b in rnd.sample(range(64), bits)) for _ in range(count)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _neighbours(radius: int, crowd: int):
    """Pairs of near texts, and each value that left out a text or a neighbour of one."""

    def run(batches):
        current, tree, names, marked = None, BKTree(), [], False
        for batch in batches:
            out, crowded = [], []
            for value, fp, name in zip(*(batch.column(c).to_pylist() for c in ("value", "fp", "text_id")), strict=True):
                if value != current:
                    current, tree, names, marked = value, BKTree(), [], False
                fp &= 0xFFFFFFFFFFFFFFFF
                near = tree.within(fp, radius)
                if len(near) >= crowd and not marked:
                    crowded.append(value)
                    marked = True
                if len(near) > 2 * crowd:
                    near = sorted(near, key=lambda n: ((fp ^ tree.values[n]).bit_count(), n))[: 2 * crowd]
                out += [(name, names[n]) for n in near]
                if len(near) < crowd:
                    tree.add(fp)
                    names.append(name)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            ends = [pa.concat_arrays([pa.array(pairs[:, i].copy()), pa.nulls(len(crowded), pa.int64())]) for i in (0, 1)]
            values = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(crowded, pa.int64())])
            yield pa.RecordBatch.from_arrays([*ends, values], names=["a", "b", "crowded"])

    return run


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of the sorted set ``own`` each of the other sets holds; none is empty."""
    if not len(own):
        return np.zeros(len(others), np.int64)
    values = np.concatenate(others)
    found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    return np.add.reduceat(found.astype(np.int64), np.cumsum([0, *(len(o) for o in others[:-1])]))


def _links(fp, root, left, right, sets, radius: int, similarity: float):
    """Index pairs of texts that share enough of their shingles, each joining two roots that
    no earlier pair has joined."""
    root, sizes = root.copy(), np.array([len(s) for s in sets])
    for i in left.tolist():
        # Two texts without shingles share all of them.
        alike = np.minimum(sizes[right], sizes[i]) >= similarity * np.maximum(sizes[right], sizes[i])
        near = right[alike & (root[right] != root[i]) & (np.bitwise_count(fp[right] ^ fp[i]) <= radius)]
        for low in range(0, len(near), STEP):
            part = near[low : low + STEP]
            shared = _shared(sets[i], [sets[j] for j in part.tolist()]) if sizes[i] else np.zeros(len(part), np.int64)
            for j in part[shared >= similarity * (sizes[i] + sizes[part] - shared)].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    yield i, j


def _block_pairs(radius: int, similarity: float | None):
    """Pairs within the radius, of different roots, between two blocks of a value; with a
    similarity, a forest of those that share as much of their shingles."""

    def compare(rows: list[tuple]):
        *columns, sets = zip(*rows)
        fp, name, root, side = (np.concatenate(c) for c in columns)
        fp = fp.view(np.uint64)
        # Side 0 is a block met by itself, 1 and 2 are two blocks.
        left = np.flatnonzero(side < 2)
        right = left if not side.any() else np.flatnonzero(side == 2)
        if similarity is not None:
            found = np.array([*_links(fp, root, left, right, [s for part in sets for s in part], radius, similarity)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(name[found[:, c]]) for c in (0, 1)], names=["a", "b"])
            return
        for low in range(0, len(left), STEP):
            own = left[low : low + STEP]
            near = np.bitwise_count(fp[own, None] ^ fp[None, right]) <= radius
            i, j = np.nonzero(near & (root[own, None] != root[None, right]))
            yield pa.RecordBatch.from_arrays([pa.array(name[own[i]]), pa.array(name[right[j]])], names=["a", "b"])

    def run(batches):
        rows, current = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("value", "i", "j")], axis=1)
            columns = [batch.column(c).to_numpy() for c in ("fp", "text_id", "root", "side")]
            sets = _arrays(batch.column("shingles")) if similarity is not None else []
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if low == high:
                    continue
                key = tuple(keys[low].tolist())
                if key != current and rows:
                    yield from compare(rows)
                    rows = []
                current = key
                rows.append((*(c[low:high] for c in columns), sets[low:high]))
        if rows:
            yield from compare(rows)

    return run


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text, sorted."""
    rows = [np.zeros(0, np.uint64)] * len(column)
    for low, data, offsets in K.buffers(column):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
        if not len(starts):
            continue
        words = K.hash_words(data, starts, ends)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if a < b:
                rows[low + i] = np.unique(K.hash_windows(words[a:b], min(shingle, b - a)))
    return rows


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, each as an array."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            rows = [np.sort(r.view(np.int64)) for r in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), _lists(rows)], names=["text_id", "shingles"])

    return run


def _prints(shingle: int):
    """SimHash of the distinct shingles, as the similarity counts each once."""

    def run(batches):
        for batch in batches:
            found, least = np.zeros(batch.num_rows, np.uint64), []
            for i, hashes in enumerate(shingle_sets(batch.column("text"), shingle)):
                least.append(np.sort(hashes.view(np.int64))[:SKETCH])
                if len(hashes):
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    found[i] = np.packbits(2 * bits.sum(axis=0) > len(hashes), bitorder="little").view(np.uint64)[0]
            columns = [*(batch.column(k) for k in KEY), pa.array(found.view(np.int64)), _lists(least)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "fp", "sketch"])

    return run


def _dealt(texts: DataFrame) -> DataFrame:
    """``texts`` once for each value of a sample of bits."""
    bits, count = samples(texts.count())
    values = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(bits, count))))
    return texts.select("*", F.explode(values).alias("value"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(texts: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of ``texts`` (text_id, fp, place), and the values that
    had a crowd, of which pairs are left out; place orders a tree."""
    ordered = spread(_dealt(texts), "value").sortWithinPartitions("value", "place")
    found = ordered.select("value", "fp", "text_id").mapInArrow(_neighbours(radius, crowd), "a long, b long, crowded long")
    found = cut_lineage(found, "neighbours")
    crowded = found.where("crowded IS NOT NULL").select(F.col("crowded").alias("value")).distinct()
    return _pairs(found.where("crowded IS NULL")), crowded


def crowd_pairs(texts: DataFrame, crowded: DataFrame, radius: int = RADIUS, sets: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs within the radius in the crowded values, of texts (text_id, fp, root)
    with different roots.

    The texts of a value are numbered by root and cut into blocks; two blocks meet in a
    task of their own, unless all their texts have one root. A task holds two blocks.
    Without ``sets`` these are all pairs. With ``sets`` (text_id, shingles sorted) they are
    verified links that join the same texts as all verified pairs: of one task, a forest.
    """
    dealt = _dealt(texts)
    dealt = dealt.join(F.broadcast(crowded) if is_small(crowded) else crowded, "value", "left_semi")
    order = Window.partitionBy("value").orderBy("root", "text_id")
    block = F.floor((F.row_number().over(order) - 1) / BLOCK)
    if sets is not None:
        dealt = dealt.join(sets.select("text_id", F.size("shingles").alias("size")), "text_id")
        block += F.floor(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) / BLOCK_SHINGLES)
    placed = cut_lineage(dealt.select("value", "fp", "text_id", "root", block.alias("block")), "crowded")
    blocks = placed.groupBy("value", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = (blocks.select("value", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high"))) for k in "xy")
    meet = x.join(y, "value").where("block_x <= block_y AND (low_x <> high_x OR low_y <> high_y OR low_x <> low_y)")
    meet = meet.select("value", F.col("block_x").alias("i"), F.col("block_y").alias("j"))
    sides = meet.selectExpr("value", "i", "j", "inline(IF(i = j, array(named_struct('block', i, 'side', 0)), array(named_struct('block', i, 'side', 1), named_struct('block', j, 'side', 2))))")
    sent = placed.join(sides, ["value", "block"]).select("value", "i", "j", "fp", "text_id", "root", "side")
    if sets is not None:
        sent = sent.join(sets, "text_id").select(*sent.columns, "shingles")
    sent = sent.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
    return _pairs(sent.mapInArrow(_block_pairs(radius, None if sets is None else similarity), "a long, b long"))


def likely(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose least hashes do not speak against the similarity; the estimate is
    exact for texts of at most SKETCH shingles."""
    a, b = (texts.select(F.col("text_id").alias(c), F.col("sketch").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("least", F.slice(F.array_sort(F.array_union("of_a", "of_b")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("of_a", "of_b"), "least"))
    return both.where(shared >= similarity / 2 * F.size("least")).select("a", "b")


def _sets_of(ends: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Distinct shingles, sorted, of the texts with these first keys (_doc, _text_hash)."""
    paired = join_key(keyed(docs), F.broadcast(ends) if is_small(ends) else ends, "left_semi").dropDuplicates(["_text_hash"])
    texts = paired.select(F.col("_text_hash").alias("text_id"), "text")
    return cut_lineage(texts.mapInArrow(_sets(shingle), "text_id long, shingles array<long>"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts share enough of their distinct shingles (text_id, shingles)."""
    a, b = (sets.select(F.col("text_id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - shared
    return both.where(shared >= similarity * whole).select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs that share enough; only texts of a likely pair are read again, each once."""
    pairs = cut_lineage(likely(pairs, classes, similarity), "likely-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct().join(classes, "text_id").select("first._doc", "first._text_hash")
    sets = _sets_of(cut_lineage(ends, "paired-texts"), docs, shingle)
    return cut_lineage(verified(pairs, sets, similarity), "verified")


def _crowd_links(crowded: DataFrame, docs: DataFrame, classes: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links in the crowded values between texts that ``roots`` has not joined yet."""
    named = classes.join(roots, classes["text_id"] == roots["node"], "left").select("text_id", "fp", F.coalesce("root", "text_id").alias("root"), "first")
    named = cut_lineage(named, "joined-texts")
    dealt = _dealt(named).join(F.broadcast(crowded) if is_small(crowded) else crowded, "value", "left_semi")
    # Only values whose texts have several roots have a pair left.
    several = dealt.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    several = cut_lineage(several, "open-values")
    ends = dealt.join(F.broadcast(several) if is_small(several) else several, "value", "left_semi").select("first._doc", "first._text_hash").distinct()
    sets = _sets_of(cut_lineage(ends, "crowd-texts"), docs, shingle)
    links = crowd_pairs(named.drop("first"), several, RADIUS, sets, similarity)
    return cut_lineage(links, "crowd-links")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Document key and ``first``, the first key of the group its links join it to.

    Equal texts are one from the start, named by their 64-bit hash. Texts without words
    are copies of one another; a text of fewer words than a shingle is one shingle. A null
    text is empty. A null doc_id comes last. An empty table gives an empty result.
    """
    prints = cut_lineage(keyed(docs).mapInArrow(_prints(shingle), "_doc long, _text_hash long, fp long, sketch array<long>"), "fingerprints")
    first = F.min(F.struct(F.col("_doc").isNull().alias("last"), "_doc", "_text_hash")).alias("first")
    classes = prints.groupBy(F.col("_text_hash").alias("text_id")).agg(F.min("fp").alias("fp"), F.first("sketch").alias("sketch"), first)
    classes = cut_lineage(classes, "distinct-texts")
    pairs, crowded = candidates(classes.select("text_id", "fp", F.col("first").alias("place")))
    pairs = cut_lineage(pairs, "candidates")
    edges = _linked(pairs, docs, classes, shingle, similarity)
    roots = cut_lineage(components(edges), "roots")
    if not crowded.isEmpty():
        more = _crowd_links(crowded, docs, classes, roots, shingle, similarity)
        roots = cut_lineage(components(edges.unionByName(more)), "roots")
    rooted = classes.join(roots, classes["text_id"] == roots["node"], "left").select("text_id", "first", F.coalesce("root", "text_id").alias("root"))
    rooted = cut_lineage(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select(F.col("text_id").alias("_text_hash"), "root").join(firsts, "root").select("_text_hash", "first")
    return prints.select("_doc", "_text_hash").join(named, "_text_hash")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each group, all columns: the one with the smallest doc_id.

    Of rows that repeat doc_id and text one stays; which one is not defined.
    """
    kept = near_copies(docs, shingle, similarity).select("first._doc", "first._text_hash").distinct()
    rows = plain_key(wrapped(docs)).join(plain_key(kept), list(PLAIN), "left_semi")
    return rows.dropDuplicates(list(PLAIN)).select("row.*")
