from __future__ import annotations

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from ledgerlark.llm import bpe
from tests.llm.helpers import DOCS, awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_small_automaton_accepts_what_merges_produce():
    """All words of three letters up to length 7, against merging by rank."""
    import itertools

    merges = [("a", "a"), ("a", "b</w>"), ("aa", "a"), ("b", "a"), ("ba", "ba"), ("aa", "aa"), ("ba", "b</w>"), ("c", "aa"), ("aa", "b</w>")]
    symbols = [x + e for x in "abc" for e in ("", "</w>")]
    vocab = {x: i for i, x in enumerate([*symbols, *[l + r for l, r in merges]])}
    automaton = bpe.compiled(vocab, merges)
    for size in range(1, 8):
        for letters in itertools.product("abc", repeat=size):
            parts = [*letters[:-1], letters[-1] + "</w>"]
            for left, right in merges:
                i, out = 0, []
                while i < len(parts):
                    if parts[i : i + 2] == [left, right]:
                        out.append(left + right)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert automaton.encode("".join(letters)) == [vocab[p] for p in parts], letters


def test_texts_against_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    more = ["It's WE'LL don't  x<|endoftext|>y <|startoftext|><|endoftext|> <|endoftext", "İstanbul ŉ ĳ Ǆ 12³¼ é é Å ΣΑΣ ß",
            "日本語 текст nbsp em \x1c\x85 ​ １２", "🙂" * 50, "a" * 3000 + " " + "ab" * 2000, "''''ss 't 'T 'RE"]
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(more)], DOCS))
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encoded(docs, PATH).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    rows = bpe.encoded(docs.where("doc_id = 8"), PATH, with_tokens=True).collect()
    assert rows[0].ids == tokenizer.encode("one", add_special_tokens=False).ids and rows[0].decoded == "one</w>"


def test_plain_characters_and_random_words():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(bpe.model(PATH))
    pick = random.Random(3)
    chars = [c for c in map(chr, range(0x250)) if bpe.PLAIN.fullmatch(c)]
    syllables = ["th", "er", "ing", "tion", "ä", "qu", "x", "zz", "ö", "aa", "a"]
    texts = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 7)]
    texts += ["".join(pick.choice(chars) for _ in range(30)) for _ in range(500)]
    texts += [" ".join("".join(pick.choices(syllables, k=pick.randint(1, 9))) for _ in range(20)) for _ in range(500)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)), text


def test_empty(spark):
    assert bpe.encoded(empty(spark), PATH).count() == 0
