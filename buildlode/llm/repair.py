"""Conversation structure repair by iterative-deepening A*.

Turns are brought in order, their faults found, and each conversation becomes one byte a
turn. A depth-first search tries edits in ASCII order (Delete, Insert, Keep, Rerole)
under rising cost bounds; a table holds for every failed state the cost it is now known
to need at least. The first path it accepts is the cheapest and, of those, the
ASCII-least. Long conversations are searched block by block from their end: the exact
costs of a block's entry states are where the searches of the block before it end, so
time grows with the turns. Texts never enter the search; a last pass streams the ordered
turns past their edits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, ordered_turns, small_batches

#: Turns searched at once; only time hangs on it.
BLOCK = 32
#: Costs of the edits.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A turn's byte is 4 * class + fault.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
#: Search states: nothing put out yet, or the class put out last (SYSTEM, USER, ASSISTANT).
START = 0
#: The role that must follow each state; a system turn may also follow START.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cheapest way to an accepted end when no turn is left: cost and edits by state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


class _Block:
    """Search over ``turns`` whose end states have the given (cost, edits)."""

    def __init__(self, turns: bytes, ends: list[tuple[int, str]]):
        self.turns, self.ends, self.low = turns, ends, {}
        n, least = len(turns), min(cost for cost, _ in ends)
        # What turns i.. need at least: faulty turns, turns that cannot be kept (of other
        # roles, or system turns), and half of the neighbours u-u and a-a, as one edit
        # mends two at most. Also the first user or assistant turn among the healthy.
        self.need, self.head, self.pairs = [least] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.system = [False] * (n + 1)
        after, needed, pairs, system = 0, least, 0, False
        for i in range(n - 1, -1, -1):
            kind, fault = divmod(turns[i], 4)
            if fault:
                needed += DELETE
            elif kind in (USER, ASSISTANT):
                pairs += after == kind
                after = kind
            else:
                needed, after, system = needed + 1, 0, system or kind == SYSTEM
            self.need[i], self.head[i], self.pairs[i], self.system[i] = needed, after, pairs, system

    def bound(self, i: int, state: int) -> int:
        known = self.low.get(4 * i + state)
        if known is not None:
            return known
        head = self.head[i]
        clash = head != 0 and head != NEXT[state]
        spare = state == START and self.system[i]
        return max(self.need[i] - spare + (self.pairs[i] + clash + 1) // 2, 0)

    def moves(self, i: int, state: int):
        """(edit, next turn, next state, cost) of all edits, in ASCII order."""
        follows = NEXT[state]
        kind, fault = divmod(self.turns[i], 4)
        yield "D", i + 1, state, DELETE
        yield "I", i, follows, INSERT
        if fault != BLANK and fault != DUPLICATE:
            more = TRUNCATED if fault == CUT else 0
            if kind == follows or (kind == SYSTEM and state == START):
                yield "K", i + 1, kind, KEEP + more
            yield "R", i + 1, follows, REROLE + more

    def search(self, state: int) -> tuple[int, str]:
        """Least cost from the first turn in ``state``, and the ASCII-least edits of that cost."""
        limit, n = self.bound(0, state), len(self.turns)
        if not n:
            return self.ends[state]
        while True:
            path: list[str] = []
            # Frame: turn, state, cost left, untried moves, least cost seen beyond, cost to here.
            frames = [[0, state, limit, self.moves(0, state), 1 << 60, 0]]
            while frames:
                frame = frames[-1]
                i, at, left = frame[:3]
                for edit, j, to, cost in frame[3]:
                    if j == n:
                        total, tail = self.ends[to]
                        if cost + total <= left:
                            return limit, "".join(path) + edit + tail
                        frame[4] = min(frame[4], cost + total)
                    elif cost + (needs := self.bound(j, to)) <= left:
                        path.append(edit)
                        frames.append([j, to, left - cost, self.moves(j, to), 1 << 60, cost])
                        break
                    else:
                        frame[4] = min(frame[4], cost + needs)
                else:
                    # The state failed: it costs more than what was left.
                    self.low[4 * i + at] = frame[4]
                    frames.pop()
                    if frames:
                        path.pop()
                        frames[-1][4] = min(frames[-1][4], frame[5] + frame[4])
            limit = self.low[state]


def _cheapest(turns: bytes, block: int) -> tuple[int, str]:
    ends, low = list(ENDS), len(turns)
    while low > block:
        part = _Block(turns[low - block : low], ends)
        ends = [part.search(state) for state in range(4)]
        low -= block
    return _Block(turns[:low], ends).search(START)


_cached = lru_cache(1 << 16)(_cheapest)


def cheapest_edits(turns: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits that give the roles ``(s?(ua)+)?``; ties: the ASCII-least edits."""
    return _cached(turns, block) if len(turns) <= block else _cheapest(turns, block)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by a checksum of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3
    repeats it and 4 makes the user its role. A null counts as one space, in the checksum
    as in role and text; conv_id and turn stay null.
    """
    as_text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        as_text("role").alias("role"),
        as_text("text").alias("text"),
        (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20).alias("k"),
    ).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Ordered turns with ``symbol``, their class and fault but for duplicates, and a digest."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    last = F.substring(stripped, -1, 1)
    fault = F.when(stripped == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    extra = [(kind * 4 + fault).cast("int").alias("symbol"), same.alias("same")]
    return ordered_turns(rows, *extra, keep=["conv_id", "turn", "role", "text"])


def _symbols(turns: DataFrame) -> DataFrame:
    """place, conv_id, turn, symbol: later turns of equal role and text become duplicates."""
    narrow = turns.select("place", "conv_id", "turn", "symbol", "same")
    firsts = narrow.groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = cut_lineage(firsts.where("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first"), "repeated-turns")
    joined = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    again = (F.col("place") > F.col("first")) & (F.col("symbol") % 4 != BLANK)
    duplicate = F.col("symbol") - F.col("symbol") % 4 + DUPLICATE
    return joined.select("place", "conv_id", "turn", F.when(again, duplicate).otherwise(F.col("symbol")).alias("symbol"))


PIECE = T.StructType().add("conv_id", "long").add("place", "long").add("symbols", "binary")
for _name in ("low", "high", "head", "tail", "distinct"):
    PIECE = PIECE.add(_name, "long")


def _pieces(batches):
    """Runs of a conversation's turns in a batch: their bytes and what their turn numbers span."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, turns = batch.column("conv_id"), batch.column("turn")
        none = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        unset = np.asarray(turns.is_null())
        turns = turns.fill_null(0).to_numpy(zero_copy_only=False)
        place, symbols = batch.column("place").to_numpy(), batch.column("symbol").to_numpy().astype(np.uint8)
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])])
        rows = []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], n].tolist(), strict=True):
            known = turns[a:b][~unset[a:b]]
            span = [None] * 4 + [0]
            if len(known):
                # Turns are in order, null first, so the first and last are least and greatest.
                low, high = int(known[0]), int(known[-1])
                span = [low, high, low, high, int((known[1:] != known[:-1]).sum()) + 1]
            rows.append((None if none[a] else int(ids[a]), int(place[a]), symbols[a:b].tobytes(), *span))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=PIECE.names)


REPORT = T.StructType().add("conv_id", "long")
for _name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
    REPORT = REPORT.add(_name, "long")
REPORT = REPORT.add("audit", "string")

_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_ILLEGAL = np.array([[(a, b) not in _LEGAL for b in range(4)] for a in range(4)])


def _judge(pieces: list[dict]) -> tuple:
    """Gaps, fault counts, illegal pairs, cost and edits of one conversation."""
    pieces = sorted(pieces, key=lambda p: p["place"])
    turns = b"".join(p["symbols"] for p in pieces)
    codes = np.frombuffer(turns, np.uint8)
    kinds, faults = codes // 4, np.bincount(codes % 4, minlength=4)
    spans = [p for p in pieces if p["distinct"]]
    gaps = 0
    if spans:
        shared = sum(a["tail"] == b["head"] for a, b in zip(spans, spans[1:]))
        gaps = spans[-1]["high"] - spans[0]["low"] + 1 - (sum(p["distinct"] for p in spans) - shared)
    illegal = int(_ILLEGAL[kinds[:-1], kinds[1:]].sum())
    cost, audit = cheapest_edits(turns)
    return gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal, cost, audit


def _search(batches):
    for batch in batches:
        rows = [_judge(x.as_py() or []) for x in batch.column("pieces")]
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 6 else pa.string()) for i in range(7)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=REPORT.names)


def _reports(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """REPORT of every conversation of ``ids``; one byte a turn meets in a task."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    symbols = _symbols(turns).repartitionByRange(parts, "place").sortWithinPartitions("place")
    pieces = symbols.mapInArrow(_pieces, PIECE)
    listed = F.struct(*PIECE.names[1:]).alias("piece")
    both = pieces.select("conv_id", listed).unionByName(ids.select("conv_id", F.lit(None).cast(pieces.select(listed).schema[0].dataType).alias("piece")))
    grouped = both.groupBy("conv_id").agg(F.collect_list("piece").alias("pieces"))
    return cut_lineage(grouped.mapInArrow(_search, REPORT), "audits")


def _with_edits(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns in order, for a streaming pass."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "place", "role", "text", *(F.lit(None).cast(REPORT[c].dataType).alias(c) for c in REPORT.names[1:]))
    heads = reports.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), *REPORT.names[1:])
    return heads.unionByName(rows).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")


class _Conversation:
    """Applies the edits of one conversation to its turns, which come one by one."""

    def __init__(self, head: dict):
        self.head, self.at, self.state, self.count = head, 0, START, 0
        self.audit = head["audit"]

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", "user" if self.state == USER else "assistant", ""

    def turn(self, role: str, text: str):
        """(edit, role, text) that come before and with this turn."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            yield edit, "user" if self.state == USER else "assistant", text
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield edit, role, text

    def end(self):
        yield from self._inserted()


def _conversations(batches):
    """(conversation, its new turns) as turns arrive; None for the turns at its end."""
    now = None
    for batch in batches:
        head_columns = {c: batch.column(c).to_pylist() for c in REPORT.names}
        roles, texts, places = (batch.column(c).to_pylist() for c in ("role", "text", "place"))
        for i, place in enumerate(places):
            if place < 0:
                if now is not None:
                    yield now, now.end(), True
                now = _Conversation({c: v[i] for c, v in head_columns.items()})
            else:
                yield now, now.turn(roles[i], texts[i]), False
    if now is not None:
        yield now, now.end(), True


DIGEST = T.StructType([*REPORT.fields, T.StructField("repaired_sha256", T.StringType())])


def _digests(batches):
    done, sha = [], hashlib.sha256()
    for now, turns, last in _conversations(batches):
        for _, role, text in turns:
            sha.update(("\n" if now.count else "").encode() + f"{role}:{text}".encode())
            now.count += 1
        if last:
            done.append({**now.head, "repaired_sha256": sha.hexdigest()})
            sha = hashlib.sha256()
        if len(done) >= 2000:
            yield _batch(done, DIGEST)
            done = []
    if done:
        yield _batch(done, DIGEST)


REPAIRED = T.StructType().add("conv_id", "long").add("position", "long").add("edit", "string").add("role", "string").add("text", "string")


def _repaired(batches):
    out, size = [], 0
    for now, turns, _ in _conversations(batches):
        for edit, role, text in turns:
            out.append({"conv_id": now.head["conv_id"], "position": now.count, "edit": edit, "role": role, "text": text})
            now.count += 1
            size += len(text)
        if len(out) >= 2000 or size > 8 << 20:
            yield _batch(out, REPAIRED)
            out, size = [], 0
    if out:
        yield _batch(out, REPAIRED)


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in schema], names=schema.names
    )


def _plain(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    as_text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    return rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), as_text("role"), as_text("text"))


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, fault counts, illegal pairs, cost, audit, repaired_sha256.

    ``ids`` has the conv_id of conversations that may have lost all rows; they get zeros,
    no edits and the hash of the empty text. Turns are taken by turn, null first, equal
    ones by role and text; rows that repeat all columns are duplicates of one another. A
    null role or text counts as one space. Rows without a conv_id are one conversation.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = _plain(rows)
    ids = rows.select("conv_id") if ids is None else ids.select(ids["conv_id"].cast("long").alias("conv_id"))
    turns = _marked(rows)
    return _with_edits(turns, _reports(turns, ids.distinct())).mapInArrow(_digests, DIGEST)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (I, K or R), role, text.

    Cases are those of ``repair_report``; a conversation that loses all turns has no row.
    """
    turns = _marked(_plain(rows))
    return _with_edits(turns, _reports(turns, turns.select("conv_id").distinct())).mapInArrow(_repaired, REPAIRED)
