"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from buildlode.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, shard int, ids string"


def nodes_of(convs):
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        words = len(re.findall(r"[^ \t-\r]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * words
    out = Counter()
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[min(m), len(path), parent, len(m), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def rebuilt(rows):
    convs = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        shared, family = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(family, [])[:shared] + turns[shared:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)


def drawn(seed):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-50, 400), rnd.choice([3, 60, 300])):
        some = rnd.choice([1, 2, 3])
        for i in range(rnd.choice([1, 2, 3, 5, 30])):
            # Turns that repeat hold the same text, so that digests break no tie.
            rows.append((c, i if rnd.random() < 0.97 else None, rnd.choice([None, "user", "a"][:some]), rnd.choice(["x y", None, "z. b  c"][:some])))
    return rows + [(c, i, "user", "hot turn") for c in range(1000, 1150) for i in range(4)]


@pytest.mark.parametrize("seed,cells", [(1, 7), (2, 50), (3, 1 << 19), (4, 1)])
def test_nodes_equal_a_dictionary(spark, seed, cells):
    rows = drawn(seed)
    got = Counter(tuple(r) for r in trie.prefix_trie(table(spark, rows), cells=cells).collect())
    assert got == nodes_of(rebuilt(rows))


def test_as_they_are_with_a_long_conversation(spark):
    long = [(7, i, "user", f"t{i} a b") for i in range(6000)]
    rows = long + [(8, i, "user", f"t{i} a b") for i in range(5990)] + [(9, 0, "user", None), (None, 0, "user", "lost")]
    convs = {7: [(r[2], r[3]) for r in long], 8: [(r[2], r[3]) for r in long[:5990]], 9: [("user", "")]}
    # A plain count of subtrees would be quadratic: check laws of the long path instead.
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(table(spark, rows), rebuild=False, cells=4096).collect()}
    assert len(got) == 1 + 6000 + 1 and got[7, 0].n_convs == 3 and got[7, 0].n_leaves == 2
    assert got[7, 0].saved_tokens == 5990 * 3 and got[7, 5990].saved_tokens == 3 and got[7, 5991].saved_tokens == 0
    assert got[7, 5990].ends_sha256 == hashlib.sha256(b"8").hexdigest() and got[7, 6000].parent_conv_id == 7
    assert convs[9] == [("user", "")] and got[9, 1].parent_conv_id == 7


def test_turnless_and_empty(spark):
    turns = spark.createDataFrame([(4, []), (2, []), (9, [])], "conv_id long, turns array<struct<id: long, words: long>>")
    (root,) = trie.trie_nodes(turns).collect()
    assert tuple(root) == (2, 0, None, 3, 0, 1, 0, hashlib.sha256(b"2,4,9").hexdigest())
    assert trie.prefix_trie(table(spark, drawn(1)).where(F.lit(False))).collect() == []


def test_owners_follow_a_node_over_whole_shards():
    # Shard 2 lies whole inside a node of depth 3 that starts in shard 1.
    assert trie.owners([(1, 0, 1), (2, 3, 4), (5, 4, 0)]) == [(2, 0, 3, 1), (5, 3, 4, 2), (5, 0, 3, 1)]


def test_equal_keys_of_ties(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "x"), (1, 0, "a", "x")]
    got = Counter(tuple(r) for r in trie.prefix_trie(table(spark, rows), rebuild=False).collect())
    assert got == nodes_of({1: [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]})
