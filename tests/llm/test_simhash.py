from __future__ import annotations

import random

import xxhash

from ledgerlark.llm import simhash
from tests.llm.helpers import awkward, empty


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc -> smallest reachable doc, by repeated comparison of all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a[1] ^ b[1]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = {}
    for i, (doc, _) in enumerate(prints):
        members = [d for k, (d, _) in enumerate(prints) if label[k] == label[i] and d is not None]
        out.setdefault(label[i], min(members, default=None))
    return [(doc, f"{p:016x}", out[label[i]]) for i, (doc, p) in enumerate(prints)]


def test_whole_documents_against_all_pairs(spark):
    docs = awkward(spark, 2)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, found)) == sorted(map(str, plain_components(prints)))


def test_links_and_components_against_all_pairs(spark):
    """Chains of fingerprints, in tiles so small that each count has several."""
    pick = random.Random(5)
    values = set()
    for _ in range(12):
        value = pick.getrandbits(64)
        for _ in range(25):
            values.add(value)
            for bit in pick.sample(range(64), pick.randint(1, 4)):
                value ^= 1 << bit
    values |= {pick.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, value long")
    links = simhash.links(frame.select("value"), tile=8)
    rows = links.collect()
    assert all(((a & (1 << 64) - 1) ^ (b & (1 << 64) - 1)).bit_count() <= 4 for a, b in rows)
    root = {r.value: r.root for r in simhash.components(links).collect()}
    want = {doc: least for doc, _, least in plain_components(prints)}
    groups = {}
    for (doc, value) in zip(range(len(signed)), signed):
        groups.setdefault(root.get(value, value), set()).add(doc)
    assert {min(g): g for g in groups.values()} == {
        least: {d for d in want if want[d] == least} for least in set(want.values())
    }


def test_group_of_near_copies_gives_few_links():
    import numpy as np

    base = np.uint64(0x0123456789ABCDEF)
    near = np.array([base ^ np.uint64(1 << b) for b in range(64)], dtype=np.uint64).view(np.int64)
    assert len(simhash.forest(near, None, 4)) == 63


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
