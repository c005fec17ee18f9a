from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from ledgerlark.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def by_hand(rows):
    """All nodes, from every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for q in members:
        if q:
            children[q[:-1]].append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        leaves[q] = sum(leaves[x] for x in children[q]) or 1
        own_saved = (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
        saved[q] = own_saved + sum(saved[x] for x in children[q])
    out = []
    for q, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(q))
        parent = min(members[q[:-1]]) if q else None
        out.append((min(convs), len(q), parent, len(convs), len(children[q]), leaves[q], saved[q],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(frame, **options):
    return [tuple(r) for r in trie.prefix_trie(frame, **options).collect()]


def awkward_rows():
    rows = [(c, t, "user", f"turn {t % 3} of {c % 4}") for c in range(40) for t in range(c % 13)]
    rows += [(100 + c, t, "user" if t % 2 else None, "same é\U0001f600") for c in range(30) for t in range(11)]
    rows += [(200, None, "user", "first"), (200, 0, None, None), (200, 0, None, None), (200, 1, "", ""),
             (None, 1, "user", "nobody"), (7, None, None, None), (2**62 + 1, 5, "user", "x" * 70000)]
    rows += [(300 + c, t, "user", f"long {t}") for c in range(12) for t in range(20 + 4 * c)]
    rows += [(400, t, "user", f"alone {t}") for t in range(60)]
    return rows


@pytest.mark.parametrize(("segment", "partitions"), [(4, "9"), (20, "1"), (128, "9")])
def test_nodes_against_all_prefixes(spark, segment, partitions):
    rows = awkward_rows()
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    for name in ("position", "level", "path", "_tie", "_place", "number", "shard"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, nodes(frame, segment=segment))) == sorted(map(str, by_hand(rows)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_ends_of_one_node(spark, monkeypatch):
    rows = [(5 * c, 0, "user", "the same") for c in range(3 * trie.ENDS_PER_PIECE)]
    assert sorted(map(str, nodes(spark.createDataFrame(rows, TURNS)))) == sorted(map(str, by_hand(rows)))


def test_empty(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
