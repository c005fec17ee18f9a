from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlark.llm import packing
from tests.llm.helpers import DOCS, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at < len(gaps):
            gap = gaps.pop(at) - length
        else:
            gap, bins = capacity - length, bins + 1
        bisect.insort(gaps, gap)
    return bins


def check(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["uniform", "short", "halves", "one"])
def test_sequences_are_valid_and_few(spark, kind):
    pick = random.Random(kind)
    draw = {"uniform": lambda: pick.randint(1, 100), "short": lambda: pick.randint(1, 30),
            "halves": lambda: pick.choice([50, 51, 49, 25]), "one": lambda: 34}[kind]
    lengths = [draw() for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.packed(frame, ["doc_id"], 100).collect()
    assert sorted((r.doc_id, r["length"]) for r in rows) == list(enumerate(lengths))
    assert check(rows, 100) <= best_fit_decreasing(lengths, 100) * 1.02 + 1


def test_pieces_against_the_library(spark):
    docs = awkward(spark, 2).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(
        [(50, "a<|endoftext|>b <|endoftext|><|endoftext|> 'll it's  x\n\n y\t\tz ¼²ªµ\xa0é １２  ", "en", "s", 1),
         (51, "word " * 5000 + "日本語 текст", "en", "s", 1), (52, "0" * 7000, "en", "s", 1)], DOCS))
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH).collect()
    assert check(rows, 2048) > 0
    want = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or min(2048, len(ids))
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    got = [(r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_split_of_plain_characters_is_the_librarys():
    tokenizer = Tokenizer.from_file(PATH)
    chars = [c for c in map(chr, range(0x250)) if packing.PLAIN.fullmatch(c)]
    pick = random.Random(1)
    for _ in range(3000):
        text = "".join(pick.choice(chars) if pick.random() < 0.7 else pick.choice(" \n'as") for _ in range(20))
        ids = np.frombuffer(packing.encoder(PATH).encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_as_output_and_empty(spark):
    rows = packing.pieces(spark.createDataFrame([(1, "hello", "en", "s", 1)], DOCS), PATH, with_ids=True).collect()
    assert rows[0].ids[-1] == 0 and len(rows[0].ids) == rows[0]["length"]
    assert packing.pack_documents(empty(spark), PATH).count() == 0
