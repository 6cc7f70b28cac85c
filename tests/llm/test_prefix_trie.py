"""Prefix trie of conversations against a trie of tuples in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidegrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, code, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def plain(rows):
    whole = rebuilt(rows)
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[node]) or 1
        saved = sum(below[k][1] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        below[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def trie(df, shard):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(prefix_trie.share_openings(prefix_trie.paths(df)), shard).collect())


@pytest.mark.parametrize("shard", [50_000, 7])
def test_conversations(spark, shard):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie(df, shard) == plain([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("shard", [50_000, 3])
def test_copies_nulls_ties_and_long_texts(spark, shard):
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(4)]  # one group of copies
    rows += [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", "b"), (7, 0, "user", "b"), (None, 1, "user", "lost")]
    rows += [(305, 1, "user", "x" * 200_000), (305, 2, "a", "é💥"), (305, 3, "a", "é💥"), (200, 0, "u", "only"), (299, 0, "u", "other")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", codes string")
    assert trie(df, shard) == plain(rows)


def test_empty(spark):
    assert trie(spark.createDataFrame([], SCHEMA), 10) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA), 10) == []


def test_nodes_outside_the_skeleton_lie_in_one_shard():
    paths = sorted(bytes([a]) * 16 + bytes([b]) * 16 for a in range(4) for b in range(6))
    splitters = [paths[0], paths[8], paths[15]]
    shards = [paths[0:8], paths[8:15], paths[15:]]
    for path in paths:
        deep = prefix_trie.in_skeleton(path, splitters)
        for d in range(deep + 1, 3):
            assert sum(any(p[: 16 * d] == path[: 16 * d] for p in s) for s in shards) == 1
