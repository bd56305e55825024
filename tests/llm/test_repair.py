"""Conversation repair: the search against a table of all states, and hand-made rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from buildlode.llm import repair


def all_states(turns):
    """Least (cost, edits) over all paths, state by state."""
    worst, now = (10**9, "~"), {0: (0, "")}

    def inserted(now):
        now = dict(now)
        for _ in range(3):
            for s, (c, p) in list(now.items()):
                t = repair.NEXT[s]
                now[t] = min(now.get(t, worst), (c + 5, p + "I"))
        return now

    for x in turns:
        kind, fault = divmod(x, 4)
        new = {}

        def put(s, v, new=new):
            new[s] = min(new.get(s, worst), v)

        for s, (c, p) in inserted(now).items():
            put(s, (c + 2, p + "D"))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.CUT else 0
                if kind == repair.NEXT[s] or (kind == repair.SYSTEM and s == 0):
                    put(kind, (c + more, p + "K"))
                put(repair.NEXT[s], (c + 1 + more, p + "R"))
        now = new
    now = inserted(now)
    return min(now.get(0, worst), now.get(3, worst))


def drawn(rnd, n):
    odd = rnd.random()
    kind = lambda i: rnd.randrange(4) if rnd.random() < odd else 2 + i % 2
    return bytes(4 * kind(i) + (rnd.randrange(4) if rnd.random() < odd else 0) for i in range(n))


def test_cheapest_edits_are_least_of_all():
    rnd = random.Random(11)
    for _ in range(1500):
        turns = drawn(rnd, rnd.randrange(14))
        for block in (1, 3, 32):
            assert repair.cheapest_edits(turns, block) == all_states(turns), turns


@pytest.mark.parametrize("pattern", [[8], [12], [4], [0], [8, 12, 8], [11], [11, 15], [8, 8, 12, 12]])
def test_long_conversations_take_linear_time(pattern):
    turns = bytes(pattern * (6000 // len(pattern)))
    assert repair.cheapest_edits(turns) == all_states(turns)


def test_lower_bound_is_never_above_the_cost():
    rnd = random.Random(3)
    for _ in range(300):
        turns = drawn(rnd, 10)
        block = repair._Block(turns, list(repair.ENDS))
        for state in range(4):
            assert block.bound(0, state) <= repair._Block(turns, list(repair.ENDS)).search(state)[0]


SCHEMA = "conv_id long, turn long, role string, text string, place int, audit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def report(spark, rows, ids=None):
    got = repair.repair_report(table(spark, rows), ids)
    return {r.conv_id: r for r in got.collect()}


def test_faults_ties_and_nulls(spark):
    rows = [
        (1, 0, "system", "s."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes"), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."),
        (2, None, None, None), (2, 4, "user", "q?"), (2, 9, "user", " \t"),
        (None, 1, "user", "a."), (None, 2, "assistant", "b."), (3, None, "assistant", "c. \n"),
    ]
    got = report(spark, rows)
    assert set(got) == {1, 2, 3, None}
    r = got[1]
    # The cut turn goes, then the first of two equal turns stays.
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (0, 0, 1, 1, 2, 4, "KKDKD")
    assert r.repaired_sha256 == hashlib.sha256(b"system:s.\nuser:Hi!\nassistant:Yes.").hexdigest()
    r = got[2]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (4, 2, 0, 0, 2, 6, "DDD")
    assert got[None].audit == "KK" and got[None].cost == 0
    assert (got[3].gaps, got[3].audit, got[3].cost) == (0, "D", 2)


def test_conversations_without_rows_and_empty_tables(spark):
    ids = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    got = report(spark, [(5, 0, "user", "a.")][:0], ids)
    empty = hashlib.sha256().hexdigest()
    assert {k: (r.gaps, r.cost, r.audit, r.repaired_sha256) for k, r in got.items()} == {5: (0, 0, "", empty), None: (0, 0, "", empty)}
    none = table(spark, [(1, 1, "user", "x")]).where(F.lit(False))
    assert repair.repair_report(none).collect() == [] and repair.damage(none).collect() == []


def test_a_conversation_over_many_tasks_and_batches(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(9000)]
    rows[4001] = (1, 4001, "user", "odd.")
    rows[7000] = (1, 7000, "user", "x" * 2_000_000 + ".")
    out = repair.repaired_turns(table(spark, rows)).collect()
    assert [r.position for r in sorted(out, key=lambda r: r.position)] == list(range(9000))
    assert [(r.edit, r.role, r.text) for r in out if r.edit != "K"] == [("R", "assistant", "odd.")]
    r = report(spark, rows)[1]
    lines = "\n".join(f"{'assistant' if i == 4001 else role}:{text}" for _, i, role, text in rows)
    assert (r.cost, r.gaps, r.illegal) == (1, 0, 2) and r.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
