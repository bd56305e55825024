"""Substring dedup: word windows that repeat across documents, with a count-min prefilter.

First pass: every task counts its windows in a count-min sketch; the sketches are merged.
A merged count is never below the true one, so a window that repeats is always estimated
to repeat. Second pass: only windows estimated to repeat are grouped, exactly.

Windows are counted by proxy. Each window is represented by the smallest hash of the
25-word sequences inside it. Equal windows have equal representatives, and neighbouring
windows mostly share one, so a text adds some 2 of 27 of its words to the sketch. A run
of windows with one representative is counted once; the count of a representative is
therefore at least the number of documents that hold the window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, cut_lineage, join_key, keyed, spread
from .sketch import maybe, membership

WINDOW = 50
#: Cells of a sketch row, and rows. One bit per cell is broadcast: 16 MB, whatever the
#: input. A fuller sketch lets more windows through to the exact pass and loses none.
CELLS = 1 << 26
ROWS = 2
#: Cells that are merged and sent together.
BLOCK = 1 << 20
#: Representatives a task holds before it sends its sketch; it starts a new one then.
HELD = 4_000_000
_PICK = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 26)


def _texts(column):
    for low, data, offsets in K.buffers(column):
        starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
        yield low, data, starts, ends, first, K.hash_words(data, starts, ends)


def _representatives(words: np.ndarray, first: np.ndarray, window: int):
    """Window starts, the representative of each, and which of them begin a run."""
    half = (window + 1) // 2
    inner = K.hash_windows(words, half)
    width = window - half + 1
    if len(inner) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    least, have = inner, 1
    while have < width:  # minimum over ``width`` neighbours by doubling
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero(K.rooms(first, window, len(words))[: len(least)])
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    texts = K.owners(first)[at]
    new[1:] |= texts[1:] != texts[:-1]
    return at, least, new


def _cells(values: np.ndarray, row: int) -> np.ndarray:
    return (values * np.uint64(_PICK[row])) >> _SHIFT


def _task_sketch(window: int):
    """The cells of a task that are 1, and those that are more, by sketch row and block."""

    def send(held):
        values = np.concatenate(held)
        out = ([], [], [], [])
        for row in range(ROWS):
            cells, counts = np.unique(_cells(values, row), return_counts=True)
            blocks = (cells // BLOCK).astype(np.int64)
            for block in np.unique(blocks):
                own = slice(*np.searchsorted(blocks, [block, block + 1]))
                place = (cells[own] % BLOCK).astype(np.uint32)
                for list_, item in zip(out, (row, int(block), place[counts[own] == 1].tobytes(), place[counts[own] > 1].tobytes()), strict=True):
                    list_.append(item)
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["row", "block", "once", "more"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for *_, first, words in _texts(batch.column("text")):
                _, least, new = _representatives(words, first, window)
                held.append(least[new])
                size += len(held[-1])
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return run


def _merge(batches):
    """Add up task sketches, one counter array per block; counts stop at 2."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, once, more in zip(*(batch.column(i) for i in range(4)), strict=True):
            cells = sums.setdefault((row.as_py(), block.as_py()), np.zeros(BLOCK, np.uint8))
            one = np.frombuffer(once.as_buffer(), np.uint32)
            cells[one] = np.minimum(cells[one] + 1, 2)
            cells[np.frombuffer(more.as_buffer(), np.uint32)] = 2
    keys = list(sums)
    bits = [np.packbits(sums[k] > 1, bitorder="little").tobytes() for k in keys]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(bits, pa.binary())],
        names=["row", "block", "bits"])


def repeated_cells(texts: DataFrame, window: int = WINDOW) -> np.ndarray:
    """The merged sketch as bits: cells with a count over 1. ROWS x CELLS / 8 bytes."""
    tasks = texts.select("text").mapInArrow(_task_sketch(window), "row int, block int, once binary, more binary")
    merged = spread(tasks, "row", "block").mapInArrow(_merge, "row int, block int, bits binary").toArrow()
    out = np.zeros((ROWS, CELLS // BLOCK, BLOCK // 8), np.uint8)
    for row, block, bits in zip(*(merged[c].to_pylist() for c in ("row", "block", "bits")), strict=True):
        out[row, block] = np.frombuffer(bits, np.uint8)
    return out.reshape(ROWS, -1)


def _may_repeat(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for row in range(ROWS):
        cell = _cells(values, row)
        ok &= ((bits[row, cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return ok


def _repeats(sketch, window: int):
    """One row for each distinct window of a text; ``more`` has its further starts."""

    def run(batches):
        for batch in batches:
            docs, hashes = (batch.column(k) for k in KEY)
            for low, _, _, _, first, words in _texts(batch.column("text")):
                at, least, _ = _representatives(words, first, window)
                at = at[_may_repeat(sketch.value, least)]
                if not len(at):
                    continue
                name = K.hash_windows(words, window)[at]
                check = (K.hash_windows(words, window, _PICK[1])[at] >> np.uint64(32)).astype(np.uint32)
                texts = K.owners(first)[at]
                place = at - first[texts]
                _, one, group = np.unique(K.mix(name, 7) + texts.astype(np.uint64), return_index=True, return_inverse=True)
                more = [None] * len(one)
                if len(one) < len(at):
                    rest = np.ones(len(at), bool)
                    rest[one] = False
                    for g, p in zip(group[rest].tolist(), place[rest].tolist(), strict=True):
                        more[g] = [*(more[g] or ()), p]
                rows = pa.array(low + texts[one])
                yield pa.RecordBatch.from_arrays(
                    [docs.take(rows), hashes.take(rows), pa.array(place[one].astype(np.int32)), pa.array(more, pa.list_(pa.int32())),
                     pa.array(name[one].view(np.int64)), pa.array(check[one].view(np.int32))], names=[*KEY, "at", "more", "w1", "w2"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Document key, start ``at`` and further starts ``more`` of windows that also start
    in a smaller doc_id.

    Windows are grouped by a 96-bit hash of their words. The minimum is combined before
    it is shuffled; a text sends each of its windows once, however often it repeats it.
    """
    texts = keyed(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(texts, window))
    schema = "_doc long, _text_hash long, at int, more array<int>, w1 long, w2 int"
    found = texts.mapInArrow(_repeats(sketch, window), schema).filter("_doc is not null")
    least = found.groupBy("w1", "w2").agg(F.min("_doc").alias("least"))
    return found.join(least, ["w1", "w2"]).filter("_doc > least").select(*KEY, "at", "more")


def _cut(window: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, removed, kept, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [""] * n
            lists = batch.column("at")
            for low, data, offsets in K.buffers(batch.column("text")):
                starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
                raw = data.tobytes()
                for i in range(len(first) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    at = lists[low + i].values
                    if at is not None:
                        at = at.to_numpy(zero_copy_only=False)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    text = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                    counts[low + i], removed[low + i] = b - a, b - a - len(stay)
                    kept[low + i], sums[low + i] = text.decode(), hashlib.sha256(text).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(counts), pa.array(removed), pa.array(kept, pa.string()), pa.array(sums, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def _with_windows(sketch, member: bool):
    """Passes on the texts that the sketch may hold, or those that it cannot."""

    def run(batches):
        for batch in batches:
            hashes = batch.column("_text_hash").to_numpy().view(np.uint64)
            some = np.zeros(len(hashes), bool)
            some[maybe(sketch.value, hashes)] = True
            yield batch.filter(pa.array(some == member))

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for every row.

    Removed is each word in a window whose words also start in a document with a smaller
    doc_id. ``kept_text`` is the other words joined by one space. A null or empty text
    has no words. Rows with the same doc_id never remove each other's words; a null
    doc_id neither removes nor loses words. An empty table gives an empty result. Other
    columns are not read.

    Only texts that may lose words are shuffled to meet their windows: a sketch of fixed
    size tells them from the others.
    """
    starts = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<int>")))
    gone = repeated_windows(docs, window).groupBy(*KEY).agg(F.flatten(F.collect_list(starts)).alias("at"))
    gone = cut_lineage(gone, "repeated-windows")
    texts, context = keyed(docs), docs.sparkSession.sparkContext
    sketch = context.broadcast(membership(gone, "_text_hash"))
    same = "_doc long, _text_hash long, text string"
    meet = join_key(texts.mapInArrow(_with_windows(sketch, True), same), gone, "left")
    rest = texts.mapInArrow(_with_windows(sketch, False), same).withColumn("at", F.lit(None).cast("array<int>"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return meet.unionByName(rest).select("_doc", "text", "at").mapInArrow(_cut(window), schema)
