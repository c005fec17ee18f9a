from __future__ import annotations

import re
import zlib
from collections import Counter

from ledgerlark.llm import variants
from tests.llm.helpers import DOCS, awkward, empty

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def near(a, b):
    """Whether one code point was inserted, deleted or replaced, by trying all places."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    others = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: (v[0] if v and n[v[0]] >= 2 * n[w] else None) for w, v in others.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(others[w]), n.get(form[w])) for w in n]


def test_variants_against_all_pairs(spark):
    words = ["banana", "bananas", "banna", "bannana", "banan", "canana", "bandana", "ÉCOLE", "École", "école", "aaaaa", "aaaaaa",
             "aaaab", "baaaa", "abcde", "abcdef", "abcdefg", "abcdefgh", "abcxe", "xbcde", "Straße", "strase", "x×y÷z", "four"]
    rows = [(i, " ".join(w for k, w in enumerate(words) if (i * 7 + k * k) % (k + 2) == 0)) for i in range(120)]
    # chains of forms: each word twice as frequent as the one before
    chain = ["kettle", "kettles", "kettlesa", "kettlesab", "kettlesabc", "kettlesabcd"]
    rows += [(1000 + i, "\n".join([w] * 2**k * 3)) for k, w in enumerate(chain) for i in range(1)]
    rows += [(2000 + i, f"{'common ' * 50}comman{i % 3} commo{'pqrst'[i % 5]}") for i in range(40)]
    rows += [(None, "common kettle"), (3000, None), (3001, ""), (3002, "longer" * 20000 + " " + "tail " * 30000)] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    for name in ("word", "n", "key", "root", "form", "at"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_hand(rows)))
    assert any(r[2] == "kettlesabcd" and r[0] == "kettles" for r in got)


def test_long_words_against_all_pairs(spark):
    """Words around the length from which on digests stand for rotations, and far beyond."""
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(70))
    words = []
    for n in (62, 63, 64, 65, 66):
        w = base[:n]
        words += [w, w[:9] + "é" + w[10:], w[:-1] + "q", "q" + w[1:], w[:30] + w[31:], w[:30] + "zz" + w[32:]]
    huge = "longer" * 2000
    words += [huge, huge[:7000] + "x" + huge[7001:], huge[:-1], huge + "é", "a" * 5000, "a" * 5001, "a" * 4999 + "b"]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(1 + (k + i) % 3))) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_hand(rows)))


def test_awkward_and_empty(spark):
    docs = awkward(spark, 3)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(str, map(tuple, variants.spelling_variants(docs).collect()))) == sorted(map(str, want))
    assert variants.spelling_variants(empty(spark)).count() == 0
