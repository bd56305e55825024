"""SimHash near-duplicates: fingerprints searched in BK-trees.

Each text gets a 64-bit fingerprint. Two fingerprints within ``RADIUS`` bits agree in at
least ``BLOCKS - RADIUS`` of ``BLOCKS`` blocks, so fingerprints are dealt out by the
values of each choice of blocks. The fingerprints of one value are kept in BK-trees of
at most ``TREE`` nodes; a value with more has several shard trees, and each of its
fingerprints is sent to all of them. A search follows only the edges whose distance is
within the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, PLAIN, cut_lineage, keyed, plain_key, spread, wrapped
from .components import components

SHINGLE = 3
RADIUS = 2
BLOCKS = 4
TREE = 4096


def _joined(data, offsets, starts, ends, first):
    """Words of each text joined by one space: bytes, starts and ends of the words."""
    keep = K.NOT_SPACE[data]
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    gaps = ends[~last]  # the separator after a word that is not the last of its text
    data = data.copy()
    data[gaps] = 0x20
    keep[gaps] = True
    moved = np.cumsum(keep) - 1
    return data[keep], moved[starts], moved[ends - 1] + 1


def fingerprint_batch(column, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in over half of the shingle hashes."""
    out = np.zeros(len(column), np.uint64)
    for low, data, offsets in K.buffers(column, K.CHUNK):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
        if not len(starts):
            continue
        data, starts, ends = _joined(data, offsets, starts, ends, first)
        counts = np.diff(first)
        shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        begin = np.cumsum(shingles) - shingles
        at = np.arange(shingles.sum()) + np.repeat(first[:-1] - begin, shingles)
        to = np.minimum(at + shingle, np.repeat(first[1:], shingles)) - 1
        raw = data.tobytes()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[at].tolist(), ends[to].tolist(), strict=True)),
            np.uint64, len(at))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(shingles)
        ones = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int64)
        major = (2 * ones > shingles[some, None]).astype(np.uint8)
        out[low + some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint(shingle: int):
    def run(batches):
        for batch in batches:
            found = fingerprint_batch(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(found)], names=[*KEY, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Document key and fingerprint ``fp`` of every row."""
    return keyed(docs).mapInArrow(_fingerprint(shingle), "_doc long, _text_hash long, fp long")


class BKTree:
    """Fingerprints in a tree: a child is filed under its distance to its parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, new = 0, len(self.values)
        while new:
            distance = (value ^ self.values[node]).bit_count()
            following = self.children[node].setdefault(distance, new)
            if following == new:
                break
            node = following
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits from ``value``."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.children[node]
            if edges:
                for d in range(distance - radius, distance + radius + 1):
                    if d in edges:
                        open_nodes.append(edges[d])
        return found


class _Shard:
    """One shard tree that meets the fingerprints of its value; yields linking edges.

    Within a tree only a spanning forest of the links is reported, and of another
    fingerprint one link to each part of that forest: the same components, few rows.
    """

    def __init__(self, radius: int):
        self.radius, self.tree, self.parent, self.ready = radius, BKTree(), [], False

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def close(self):
        if not self.ready and len(self.tree.values) > 1:
            for node, value in enumerate(self.tree.values):
                for other in self.tree.within(value, self.radius):
                    a, b = self.root(node), self.root(other)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        yield value, self.tree.values[other]
        self.ready = True

    def take(self, value: int, own: bool):
        if own:
            self.parent.append(len(self.parent))
            self.tree.add(value)
            return
        yield from self.close()
        for root in {self.root(n): n for n in self.tree.within(value, self.radius)}.values():
            yield value, self.tree.values[root]


def _search(radius: int):
    def run(batches):
        shard, current = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("value", "shard", "own", "fp")), strict=True)
            for value, number, own, fp in rows:
                if (value, number) != current:
                    if shard:
                        out += shard.close()
                    shard, current = _Shard(radius), (value, number)
                out += shard.take(fp & 0xFFFFFFFFFFFFFFFF, own)
            yield _edges(out)
        if shard:
            yield _edges(list(shard.close()))

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that keep all components.

    Trees are shipped by a shuffle on the block value, not through the driver: together
    they hold all fingerprints, which no broadcast may.
    """
    bits = 64 // blocks
    masks = [
        sum(((1 << bits) - 1) << (bits * b) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    values = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    dealt = distinct.select("fp", F.explode(values).alias("value"))
    sizes = dealt.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    met = dealt.join(sizes, "value").withColumn("shards", F.ceil(F.col("n") / tree).cast("int"))
    home = F.pmod(F.xxhash64("fp", "value"), F.col("shards")).cast("int")
    rows = met.select("value", "fp", home.alias("home"), F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"))
    rows = rows.select("value", "shard", (F.col("shard") == F.col("home")).alias("own"), "fp")
    ordered = spread(rows, "value", "shard").sortWithinPartitions("value", "shard", F.col("own").desc(), "fp")
    return ordered.mapInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS):
    """Document key, ``fp``, ``component_id`` and ``first``, the component's first key.

    The component is what the links of at most ``radius`` bits join; its id is its
    smallest doc_id.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("_doc").isNull().alias("last"), *KEY)).alias("first")
    groups = cut_lineage(prints.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = cut_lineage(components(links(groups.select("fp"), radius)), "roots")
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        groups["fp"], F.coalesce("root", groups["fp"]).alias("root"), "first"
    )
    rooted = cut_lineage(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return prints.join(named, "fp").withColumn("component_id", F.col("first._doc"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    Null and empty texts, or texts of white space only, have the fingerprint zero and are
    linked like any other. Equal rows fall together. A null doc_id is never the id of a
    component that has another. An empty table gives an empty result. Other columns are
    not read.
    """
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs, shingle, radius).select(
        F.col("_doc").alias("doc_id"), digits.alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The first row of each component, all columns: the one with the smallest doc_id.

    Of rows that repeat doc_id and text one stays; which one is not defined.
    """
    kept = near_duplicates(docs, shingle, radius).select("first._doc", "first._text_hash").distinct()
    rows = plain_key(wrapped(docs)).join(plain_key(kept), list(PLAIN), "left_semi")
    return rows.dropDuplicates(list(PLAIN)).select("row.*")
