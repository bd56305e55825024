"""Benchmark decontamination as a prefix-filtered set join.

An item is a set of windows of ``WINDOW`` words; a window is the set of its shingles.
A document that contains a window contains all its shingles, so one necessary shingle,
the prefix, is enough to find it. Shingles are ordered by how often they occur in the
documents and the rarest is the prefix. Documents and windows are joined on it, pairs
whose window would not fit the text around the shingle are dropped (length and
positional bounds), and what is left is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, cut_lineage, join_key, keyed
from .sketch import maybe, membership

WINDOW = 10
#: Words in a shingle; a window of fewer words is one shingle.
SHINGLE = 3


def _words(column, table=K.ALNUM):
    """Lower-cased words of the texts: rows, bytes, starts, ends, first word of each text."""
    for low, data, offsets in K.buffers(column):
        data = K.LOWER[data]
        yield (low, data, *K.spans(data, offsets, table))


def _shingles(words: np.ndarray, first: np.ndarray, size: int):
    """Word positions of all shingles of ``size`` words, and their hashes."""
    h = K.hash_windows(words, size)
    ok = np.flatnonzero(K.rooms(first, size, len(words))[: len(h)])
    return ok, h[ok]


def _item_windows(window: int, shingle: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            ids = batch.column("item_id").to_pylist()
            for low, data, starts, ends, first in _words(batch.column("text")):
                raw, hashes = data.tobytes(), K.hash_words(data, starts, ends)
                words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                by_size = {s: K.hash_windows(hashes, s).view(np.int64) for s in range(1, shingle + 1)}
                for i in range(len(first) - 1):
                    n = int(first[i + 1] - first[i])
                    length = min(n, window)
                    size = min(length, shingle)
                    for at in range(first[i], first[i + 1] - length + 1 if n else first[i]):
                        out[0].append(ids[low + i])
                        out[1].append(" ".join(words[at : at + length]))
                        out[2].append(size)
                        out[3].append(by_size[size][at : at + length - size + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.list_(pa.int64()))], names=["item_id", "window", "size", "shingles"])

    return run


def _shingle_counts(sketch, sizes):
    def run(batches):
        for batch in batches:
            for _, data, starts, ends, first in _words(batch.column("text")):
                words = K.hash_words(data, starts, ends)
                for size in sizes:
                    _, h = _shingles(words, first, size)
                    found, n = np.unique(h[maybe(sketch.value, h)], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return run


NEAR = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("near", pa.list_(pa.string()))]))


def _candidates(sketch, sizes, window: int):
    def run(batches):
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for low, data, starts, ends, first in _words(batch.column("text")):
                counts[low : low + len(first) - 1] = np.diff(first)
                words, texts = K.hash_words(data, starts, ends), K.owners(first)
                for size in sizes:
                    at, h = _shingles(words, first, size)
                    some = maybe(sketch.value, h)
                    for w, token in zip(at[some].tolist(), h[some].view(np.int64).tolist(), strict=True):
                        i = texts[w]
                        a, b = max(int(first[i]), w - window + 1), min(int(first[i + 1]), w + window)
                        near = [data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                        found[low + i].append(
                            {"token": token, "at": w - int(first[i]), "low": a - int(first[i]), "near": near})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in KEY), pa.array(counts), pa.array(found, NEAR)],
                names=[*KEY, "n_words", "found"])

    return run


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE):
    """Per document its number of words; all occurrences of windows; items of windows.

    Returns three tables: (document key, n_words), (document key, start, length, window)
    and (window, item_id). The items are never broadcast: a sketch of fixed size keeps
    the documents' shingles apart that may be a prefix, the rest is an ordinary join.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    listed = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    windows = cut_lineage(
        listed.mapInArrow(_item_windows(window, shingle), "item_id long, window string, size int, shingles array<long>"),
        "item-windows",
    )
    items_of = windows.select("window", "item_id").filter("item_id is not null").distinct()
    distinct = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    parts = cut_lineage(distinct.select("window", "size", F.posexplode("shingles").alias("offset", "shingle")), "shingles")
    sizes = [r[0] for r in parts.select("size").distinct().collect()]  # at most SHINGLE values

    every = spark.sparkContext.broadcast(membership(parts, "shingle"))
    counts = (
        texts.select("text")
        .mapInArrow(_shingle_counts(every, sizes), "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    prefixes = cut_lineage(
        parts.join(counts, "shingle", "left")
        .groupBy("window")
        .agg(rarest)
        .select("window", F.col("rarest.shingle").alias("token"), F.col("rarest.offset").alias("offset")),
        "prefixes",
    )
    chosen = spark.sparkContext.broadcast(membership(prefixes, "token"))
    schema = "_doc long, _text_hash long, n_words long, found array<struct<token:long,at:int,low:int,near:array<string>>>"
    found = cut_lineage(texts.mapInArrow(_candidates(chosen, sizes, window), schema), "prefix-hits")

    length = F.size(F.split("window", " "))
    start = F.col("at") - F.col("offset")
    near = F.array_join(F.slice("near", F.col("start") - F.col("low") + 1, F.col("length")), " ")
    hits = (
        found.select(*KEY, "n_words", F.inline("found"))
        .join(prefixes.withColumn("length", length), "token")
        .withColumn("start", start)
        .filter("start >= low and start + length <= n_words and start + length <= low + size(near)")
        .filter(near == F.col("window"))
        .select(*KEY, "start", "length", "window")
        .distinct()
    )
    return found.select(*KEY, "n_words"), cut_lineage(hits, "window-hits"), items_of


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    A null or empty text has no words, so nothing hits it; an item without words has no
    window; a null item_id hits words but is not listed. Rows that repeat doc_id and text
    each get the document's result. Either table may be empty. Other columns are not read.
    """
    counts, hits, items_of = matches(docs, items, window)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy(*KEY).orderBy("start", "length", "window").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    words = hits.withColumn("fresh", fresh).groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*KEY, "window").distinct().join(items_of, "window")
    listed = named.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = join_key(join_key(counts, words, "left"), listed, "left")
    items_list = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        F.col("_doc").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    _, hits, _ = matches(docs, items, window)
    bad = hits.select(*KEY).distinct()
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (text == bad["_text_hash"])
    return docs.join(bad, same, "left_anti")
