"""Prefix trie of conversations from padded matrices of turn ids.

Every distinct turn gets an integer, a conversation becomes a row of integers, and Spark
sorts the rows over range shards. In a shard, blocks of rows are padded to matrices and
lexsorted; an OR over the columns of the changes from row to row marks where a node of
each depth starts, and ``reduceat`` sums every depth. Nodes at the border of a block or
shard come out in parts: parts inside a shard share a number, and the common prefixes of
neighbouring shards tell which nodes of two shards are one. Parts are then added up.

A longer row sorts before its own prefix, so a node whose first row ends there is a leaf.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_small
from .common import SPACES, cut_lineage, ordered_turns, small_batches
from .naming import sorted_names

#: Cells of a padded matrix; a longer conversation is a matrix of one row.
CELLS = 1 << 19
#: Conversations that share their first turns, and the largest number of shared turns.
FAMILY, SHARED = 20, 4
#: Sorts after all turn ids.
END = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256().hexdigest()

FINAL, PART, ENDING, LAST = range(4)
OUT = T.StructType().add("kind", "integer").add("shard", "long").add("no", "long").add("depth", "long").add("conv_id", "long")
for _name in ("parent_conv_id", "parent_no", "n_convs", "n_children", "n_leaves", "row_tokens", "node_tokens"):
    OUT = OUT.add(_name, "long")
OUT = OUT.add("ends_sha256", "string")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: (id, words) in order. Equal role and text, equal id."""
    as_text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), as_text("role"), as_text("text")
    )
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.regexp_count("text", F.lit(SPACES.replace("[", "[^") + "+"))
    turns = ordered_turns(rows, words.alias("words"), same.alias("same"), keep=["conv_id"])
    names = sorted_names(turns.select("same").distinct(), ["same"], "id", "turn-names")
    # Written, so that this join only joins and Spark may split a very common turn.
    named = turns.join(F.broadcast(names) if is_small(names) else names, "same").select("conv_id", F.struct("place", "id", "words").alias("turn"))
    listed = F.array_sort(F.collect_list("turn"))
    return named.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["id"].alias("id"), t["words"].cast("long").alias("words"))).alias("turns"))


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its family's first one in place of its own."""
    turns = cut_lineage(turns, "conversations")
    first = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, SHARED - 1).alias("opening"))
    both = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "family", "left")
    shared = f"cast(crc32(cast(conv_id AS string)) % {SHARED} AS int)"
    opening = f"CASE WHEN opening IS NULL THEN slice(turns, 1, 0) ELSE slice(opening, 1, {shared}) END"
    rest = f"CASE WHEN size(turns) > {shared} THEN slice(turns, {shared} + 1, size(turns)) ELSE slice(turns, 1, 0) END"
    return both.selectExpr("conv_id", f"concat({opening}, {rest}) AS turns")


def common_prefix(a: str, b: str) -> Column:
    """Length of the common prefix of two array columns."""
    differs = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return F.expr(f"cast(CASE WHEN {differs} = 0 THEN size({a}) ELSE {differs} - 1 END AS long)")


def _shards(turns: DataFrame) -> DataFrame:
    """The rows in sort order with ``shard`` and ``place``, equal ones by conv_id."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")), "turn-ids")
    key = F.array_append("ids", F.lit(END))
    ordered = rows.repartitionByRange(parts, key, "conv_id").sortWithinPartitions(key, "conv_id")
    placed = ordered.select(F.spark_partition_id().cast("long").alias("shard"), F.monotonically_increasing_id().alias("place"), "*")
    return cut_lineage(placed, "trie-shards")


def _borders(shards: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, before, inside) of all shards with rows, in order: the prefix its first row
    shares with the row before it, and with its last row. Three numbers a shard."""
    spark = shards.sparkSession
    edges = shards.groupBy("shard").agg(F.min_by("ids", "place").alias("first"), F.max_by("ids", "place").alias("last"))
    edges = cut_lineage(edges, "shard-edges")
    order = sorted(r.shard for r in edges.select("shard").collect())
    before = spark.createDataFrame(list(zip(order, [None, *order])), "shard long, previous long")
    previous = edges.select(F.col("shard").alias("previous"), F.col("last").alias("tail"))
    both = edges.join(F.broadcast(before), "shard").join(previous, "previous", "left")
    lengths = both.select("shard", F.coalesce(common_prefix("tail", "first"), F.lit(0)).alias("before"), common_prefix("first", "last").alias("inside"))
    return sorted(tuple(r) for r in lengths.collect())


def owners(borders: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(shard, low, high, owner): nodes of the shard's first row with low < depth <= high
    are the nodes of the same depth on the last row of the owner."""
    out = []
    for k, (shard, before, _) in enumerate(borders):
        high, j = before, k - 1
        while high > 0:
            low = min(borders[j][1:])
            if low < high:
                out.append((shard, low, high, borders[j][0]))
                high = low
            j -= 1
    return out


def sha_of_ids(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class ShardTrie:
    """Nodes of one shard, block by block. ``before`` columns of its first row are not new."""

    def __init__(self, shard: int, before: int):
        self.shard, self.before = shard, before
        self.last: np.ndarray | None = None  # the row before the next block
        self.path = np.arange(1, before + 1)  # numbers of its nodes
        self.next = 0

    def block(self, ids: np.ndarray, words: np.ndarray, lens: np.ndarray, conv: np.ndarray):
        """Yield columns of OUT for rows given as padded matrices, pads being END."""
        order = np.lexsort((conv, *ids.T[::-1])) if ids.shape[1] else np.argsort(conv)
        ids, words, lens, conv = ids[order], words[order], lens[order], conv[order]
        rows, depth = ids.shape
        new = np.ones((rows, depth), bool)
        new[1:] = ids[1:] != ids[:-1]
        if self.last is None:
            new[0] = np.arange(depth) >= self.before
            self.next = max(int(lens[0]), self.before) + 1
        else:
            known = min(depth, len(self.last))
            new[0, :known] = ids[0, :known] != self.last[:known]
            # Where the row before has ended, this row's pads are no change.
            new[0, known:] = ids[0, known:] != END
        np.logical_or.accumulate(new, axis=1, out=new)
        inside = np.arange(depth) < lens[:, None]
        fresh = new & inside
        leaf = np.zeros(rows, np.int64)
        long = np.flatnonzero(lens)
        leaf[long] = new[long, lens[long] - 1]
        row_tokens = np.cumsum(words[:, ::-1], axis=1)[:, ::-1]
        node_tokens = np.cumsum((words * fresh)[:, ::-1], axis=1)[:, ::-1]
        started = fresh.astype(np.int64)

        total = lambda m, c: int(m[:, c].sum()) if depth else 0
        root = [rows, total(started, 0), int(leaf.sum()), total(row_tokens, 0), total(node_tokens, 0)]
        yield self._columns(PART, [0], 0, [int(conv.min())], None, None, *[[x] for x in root])
        if (lens == 0).any():
            yield self._endings(0, conv[lens == 0])

        path, above = [], None
        for c in range(depth):
            starts = np.flatnonzero(new[:, c])
            if not new[0, c]:
                starts = np.r_[0, starts]
            ends = np.r_[starts[1:], rows]
            least = np.minimum.reduceat(conv, starts)
            sums = [ends - starts]
            sums += [np.add.reduceat(started[:, c + 1], starts) if c + 1 < depth else np.zeros_like(starts)]
            sums += [np.add.reduceat(x, starts) for x in (leaf, row_tokens[:, c], node_tokens[:, c])]
            closing = np.add.reduceat((lens == c + 1).astype(np.int64), starts)
            real = lens[starts] > c
            edge = real & ((starts == 0) | (ends == rows))
            number = np.zeros(len(starts), np.int64)
            for i in np.flatnonzero(edge):
                number[i] = self._number(c, bool(starts[i] == 0 and not new[0, c]), bool(starts[i] == 0))
            if edge.any() and ends[-1] == rows and edge[-1]:
                path.append(int(number[-1]))
            if above is None:
                parent_no, parent = np.zeros(len(starts), np.int64), None
            else:
                at = np.searchsorted(above[0], starts, "right") - 1
                parent_no, parent = above[1][at], above[2][at]
            whole = np.flatnonzero(real & ~edge)
            if len(whole):
                hashes = [sha_of_ids(conv[e - n : e].tolist()) if n else EMPTY_SHA for e, n in zip(ends[whole].tolist(), closing[whole].tolist(), strict=True)]
                partial = parent_no[whole] > 0 if parent is not None else np.ones(len(whole), bool)
                known = None if parent is None else pa.array(parent[whole], mask=partial)
                yield self._columns(FINAL, None, c + 1, least[whole], known, pa.array(parent_no[whole], mask=~partial), *[s[whole] for s in sums], hashes)
            parts = np.flatnonzero(edge)
            if len(parts):
                yield self._columns(PART, number[parts], c + 1, least[parts], None, parent_no[parts], *[s[parts] for s in sums])
                for i in parts.tolist():
                    if closing[i]:
                        yield self._endings(int(number[i]), conv[ends[i] - closing[i] : ends[i]])
            above = (starts, number, least)
        self.last, self.path = ids[-1, : lens[-1]].copy(), np.array(path[: lens[-1]], np.int64)

    def _number(self, c: int, continues: bool, first: bool) -> int:
        if continues:
            return int(self.path[c])
        if self.last is None and first:
            return c + 1
        self.next += 1
        return self.next - 1

    def end(self):
        """The numbers of the last row's nodes."""
        if len(self.path):
            yield self._columns(LAST, self.path, np.arange(1, len(self.path) + 1))

    def _endings(self, number: int, conv: np.ndarray):
        return self._columns(ENDING, np.full(len(conv), number), 0, conv)

    def _columns(self, kind: int, number, depth, *more) -> pa.RecordBatch:
        given = next(x for x in (number, *more) if x is not None)
        n = len(given)
        cells = [np.full(n, kind, np.int32), np.full(n, self.shard), number, np.broadcast_to(depth, n).astype(np.int64), *more]
        arrays = []
        for i, field in enumerate(OUT):
            value, kind_of = cells[i] if i < len(cells) else None, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[field.dataType.simpleString()]
            arrays.append(pa.nulls(n, kind_of) if value is None else pa.array(value, kind_of) if not isinstance(value, pa.Array) else value)
        return pa.RecordBatch.from_arrays(arrays, names=OUT.names)


def padded_blocks(lens: np.ndarray, cells: int):
    """Ranges of rows whose matrix, padded to the longest, has at most ``cells`` cells."""
    low = 0
    while low < len(lens):
        longest = np.maximum(np.maximum.accumulate(lens[low : low + cells]), 1)
        over = np.flatnonzero(longest * np.arange(1, len(longest) + 1) > cells)
        high = low + max(int(over[0]) if len(over) else len(longest), 1)
        yield low, high
        low = high


def _padded(values: np.ndarray, offsets: np.ndarray, low: int, high: int, fill: int) -> np.ndarray:
    lens = np.diff(offsets[low : high + 1])
    out = np.full((high - low, int(lens.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = values[offsets[low] : offsets[high]]
    return out


def _nodes(before: dict[int, int], cells: int):
    def run(batches):
        trie = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            conv = batch.column("conv_id").to_numpy()
            ids, words = batch.column("ids"), batch.column("words")
            flat, counts = ids.flatten().to_numpy(), words.flatten().to_numpy()
            offsets = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())].astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if trie is None or trie.shard != shard[a]:
                    if trie is not None:
                        yield from trie.end()
                    trie = ShardTrie(int(shard[a]), before[int(shard[a])])
                for low, high in padded_blocks(np.diff(offsets[a : b + 1]), cells):
                    low, high = low + a, high + a
                    matrix, tokens = _padded(flat, offsets, low, high, END), _padded(counts, offsets, low, high, 0)
                    yield from trie.block(matrix, tokens, np.diff(offsets[low : high + 1]), conv[low:high])
        if trie is not None:
            yield from trie.end()

    return run


HASHES = T.StructType().add("shard", "long").add("no", "long").add("ends_sha256", "string")


def _hash_endings(batches):
    """SHA-256 of the ids of each node, which come in order: a stream, whatever their number."""
    now, sha, out = None, None, []
    for batch in batches:
        for key, conv in zip(zip(batch.column("shard").to_pylist(), batch.column("no").to_pylist(), strict=True), batch.column("conv_id").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha, comma = key, hashlib.sha256(), ""
            sha.update(f"{comma}{conv}".encode())
            comma = ","
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=HASHES.names)


def _resolved(rows: DataFrame, alias: DataFrame, shard: str, no: str) -> DataFrame:
    """``rows`` with the key (shard, no) replaced by that of the shard where the node starts."""
    names = alias.toDF("_shard", "_no", "_to_shard", "_to_no")
    joined = rows.join(F.broadcast(names) if is_small(names) else names, (F.col(shard) == F.col("_shard")) & (F.col(no) == F.col("_no")), "left")
    root = F.col(no) == 0
    return joined.withColumns(
        {shard: F.when(root, -1).otherwise(F.coalesce("_to_shard", shard)), no: F.coalesce("_to_no", no)}
    ).drop("_shard", "_no", "_to_shard", "_to_no")


def _with_parents(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``nodes`` with the conv_id of parents that came out in parts."""
    parents = merged.select(F.col("shard").alias("_s"), F.col("no").alias("_n"), F.col("conv_id").alias("_conv"))
    same = (F.col("parent_shard") == F.col("_s")) & (F.col("parent_no") == F.col("_n"))
    joined = nodes.join(F.broadcast(parents) if is_small(parents) else parents, same, "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))


SUMS = ["n_convs", "n_children", "n_leaves", "row_tokens", "node_tokens"]


def trie_nodes(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turns: array of (id, words)).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that one copy of each node in the subtree saves), ends_sha256.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = _shards(turns)
    borders = _borders(shards)
    rows = shards.select("shard", "place", "conv_id", "ids", "words").repartition(parts, "shard").sortWithinPartitions("shard", "place")
    found = cut_lineage(rows.mapInArrow(_nodes({k: b for k, b, _ in borders}, cells), OUT), "trie-nodes")

    spans = spark.createDataFrame(owners(borders), "shard long, low long, high long, owner long")
    lasts = found.where(F.col("kind") == LAST).select(F.col("shard").alias("owner"), "depth", F.col("no").alias("to_no"))
    alias = F.broadcast(spans).join(lasts, "owner").where("depth > low AND depth <= high")
    alias = cut_lineage(alias.select("shard", F.col("depth").alias("no"), F.col("owner").alias("to_shard"), "to_no"), "shared-nodes")

    own = found.withColumn("parent_shard", F.when(F.col("parent_no").isNotNull(), F.col("shard")))
    split = _resolved(_resolved(own.where(F.col("kind") == PART), alias, "shard", "no"), alias, "parent_shard", "parent_no")
    up = F.min(F.struct("parent_shard", "parent_no")).alias("up")
    merged = split.groupBy("shard", "no", "depth").agg(F.min("conv_id").alias("conv_id"), up, *[F.sum(c).alias(c) for c in SUMS])
    merged = cut_lineage(merged.select("*", "up.*").drop("up"), "merged-nodes")
    endings = _resolved(found.where(F.col("kind") == ENDING).select("shard", "no", "conv_id"), alias, "shard", "no")
    endings = endings.repartition(parts, "shard", "no").sortWithinPartitions("shard", "no", "conv_id").mapInArrow(_hash_endings, HASHES)
    parted = merged.join(cut_lineage(endings, "node-ends"), ["shard", "no"], "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
    # A root without children is its own only leaf.
    parted = parted.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")))
    whole = _resolved(own.where(F.col("kind") == FINAL), alias, "parent_shard", "parent_no")
    names = ["conv_id", "depth", "parent_conv_id", "parent_shard", "parent_no", *SUMS, "ends_sha256"]
    nodes = _with_parents(whole.select(*names).unionByName(parted.select(*names)), merged)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("row_tokens") - F.col("node_tokens")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuild: bool = True, cells: int = CELLS) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt with shared openings or as they are.

    Turns are taken by turn, null first, equal ones by role and text. A null role or text
    is empty; rows without a conv_id belong to no conversation and are left out; repeated
    rows are turns of their own. An empty table has no root and gives an empty result.
    Other columns are not read.
    """
    small_batches(conversations.sparkSession)
    turns = conversation_turns(conversations)
    return trie_nodes(rebuilt_conversations(turns) if rebuild else turns, cells)
