"""BPE by a deterministic automaton over tokens.

The merges of a vocabulary are compiled one after the other.  At first any two
symbols may follow each other.  The gadget for a merge (u, v) -> w takes from
the state after u the arc v, gives the state after w the arcs that the state
after v had, and gives every state with an arc u an arc w.  What remains are
exactly the token sequences that the merges produce, and each string has one.
States and arcs that behave alike are then joined into classes, which leaves a
table of some MB that is broadcast: its size follows the vocabulary alone.

A word is encoded by one pass over its positions: the last token of each prefix
is the one whose arc the table allows after the last token of what is before.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import workers_see_package

END_OF_WORD = "</w>"

#: Bits of the number of a byte letter; they go up to U+0143.
LETTER_BITS = 9

#: Words whose encoding a worker remembers; then it starts anew.
REMEMBERED = 600_000

#: Letters and numbers of the characters up to U+017F, whose lower case is there too, and the
#: vocabulary's own split for them.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
PLAIN = re.compile("[\t\n\r -~¡-ſ]*")
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    return [chr(byte) if byte in own else chr(0x100 + others.index(byte)) for byte in range(256)]


@dataclass(frozen=True)
class Automaton:
    """Arcs are tokens: ``allowed[state]`` has a bit for each class of arcs, and ``state[token]``
    is the state after it."""

    labels: list[str]
    start: int
    state: list[int]
    arc: list[int]
    allowed: list[bytes]

    @cached_property
    def spelling(self) -> tuple[dict[int, int], list[int], list[int]]:
        """A tree of the labels: (node and letter -> node, token of a node within a word, at its end)."""
        step: dict[int, int] = {}
        within, at_end = [-1], [-1]
        for token, label in enumerate(self.labels):
            node = 0
            for letter in label.removesuffix(END_OF_WORD):
                key = node << LETTER_BITS | ord(letter)
                if key not in step:
                    step[key] = len(within)
                    within.append(-1)
                    at_end.append(-1)
                node = step[key]
            (at_end if label.endswith(END_OF_WORD) else within)[node] = token
        return step, within, at_end

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte letters.

        From each place that a token sequence reaches, the tree gives the
        tokens that begin there and the table those that may follow; the last
        token of each prefix is thus found once, as it is unique.
        """
        size = len(word)
        step, within, at_end = self.spelling
        state, arc, allowed = self.state, self.arc, self.allowed
        letters = [*map(ord, word)]
        last, begins, after = [-1] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        after[0] = self.start
        final = size - 1
        for begin in range(size):
            here = after[begin]
            if here < 0:
                continue
            may, node = allowed[here], 0
            for at in range(begin, size):
                node = step.get(node << LETTER_BITS | letters[at])
                if node is None:
                    break
                token = at_end[node] if at == final else within[node]
                if token >= 0:
                    target = arc[token]
                    if may[target >> 3] >> (target & 7) & 1:
                        last[at + 1], begins[at + 1], after[at + 1] = token, begin, state[token]
        out, end = [], size
        while end:
            if last[end] < 0:
                raise ValueError("the vocabulary has no symbol for a byte")
            out.append(last[end])
            end = begins[end]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class, class of each row) of equal rows of bytes."""
    digests = np.array([hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in rows])
    _, first, inverse = np.unique(digests, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def compiled(vocab: dict[str, int], merges: list[tuple[str, str]]) -> Automaton:
    """The automaton of a vocabulary whose symbols are those that no merge makes.

    ``arcs`` has a row for each token and a bit for each state: whether the
    token may follow.  Tokens that end a word lead to no state with arcs.
    """
    made = {left + right for left, right in merges}
    symbols = [token for token in vocab if token not in made]
    labels = sorted(vocab, key=vocab.get)
    states = {label: i + 1 for i, label in enumerate(x for x in labels if not x.endswith(END_OF_WORD))}
    arcs = np.zeros((len(labels), (len(states) + 8) // 8), np.uint8)
    begin = np.zeros(arcs.shape[1], np.uint8)
    for number in [0, *[states[x] for x in symbols if x in states]]:
        begin[number >> 3] |= 1 << (number & 7)
    for token in symbols:
        arcs[vocab[token]] = begin
    for left, right in merges:
        first, second, whole = vocab[left], vocab[right], vocab[left + right]
        byte, bit = states[left] >> 3, states[left] & 7
        if not arcs[second, byte] >> bit & 1:
            continue  # an earlier merge parts them always
        if (new := states.get(left + right)) is not None:
            old = states[right]
            copied = arcs[:, old >> 3] >> np.uint8(old & 7) & np.uint8(1)
            arcs[:, new >> 3] |= copied << np.uint8(new & 7)
        arcs[second, byte] &= 0xFF ^ (1 << bit)
        arcs[whole] = arcs[first]
    kinds, arc = _classes(arcs)
    by_state = np.unpackbits(arcs[kinds], axis=1, bitorder="little")[:, : len(states) + 1].T
    packed = np.packbits(np.ascontiguousarray(by_state), axis=1, bitorder="little")
    groups, state = _classes(packed)
    after = [int(state[states[x]]) if x in states else -1 for x in labels]
    rows = [packed[number].tobytes() for number in groups]
    return Automaton(labels, int(state[0]), after, [int(x) for x in arc], rows)


@dataclass(frozen=True)
class Model:
    """A tokenizer file: its automaton and its special tokens."""

    automaton: Automaton
    special: dict[str, int]
    text: str


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    content = json.loads(text)
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in content["model"]["merges"]]
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    return Model(compiled(content["model"]["vocab"], merges), special, text)


class Encoder:
    """Whole texts to ids and back, as joined strings, with remembered words."""

    def __init__(self, model: Model):
        from tokenizers import Tokenizer

        self.automaton, self.special = model.automaton, model.special
        splitter = Tokenizer.from_str(model.text)  # its normalizer and split, for rare characters
        self.normalize = splitter.normalizer.normalize_str
        self.split = splitter.pre_tokenizer.pre_tokenize_str
        parts = "|".join(re.escape(x) for x in sorted(model.special, key=len, reverse=True))
        self.cut = re.compile(f"({parts})")
        self.letters = byte_letters()
        self.ids: dict[str, str] = {}
        self.labels: dict[str, str] = {}

    def learn(self, key: str, letters: str) -> None:
        ids = self.automaton.encode(letters)
        self.ids[key] = " ".join(map(str, ids))
        self.labels[key] = self.automaton.decode(ids)

    def words(self, text: str) -> list[str]:
        """Keys of the words of ``text``, all of them learnt."""
        if PLAIN.fullmatch(text):
            words = WORDS.findall(text.lower())
            for word in set(words).difference(self.ids):
                self.learn(word, "".join(map(self.letters.__getitem__, word.encode())))
            return words
        pieces = [piece for piece, _ in self.split(self.normalize(text))]
        words = [f" {piece}" for piece in pieces]  # no plain word has a space
        for word, piece in zip(words, pieces):
            if word not in self.ids:
                self.learn(word, piece)
        return words

    def encode(self, text: str) -> tuple[str, str]:
        """(ids, labels), each joined by one space."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.labels.clear()
        ids: list[str] = []
        labels: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                ids.append(str(self.special[part]))
                labels.append(part)
            else:
                words = self.words(part)
                ids += map(self.ids.__getitem__, words)
                labels += map(self.labels.__getitem__, words)
        return " ".join(ids), " ".join(labels)


_ENCODERS: dict[str, Encoder] = {}


def encoded(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    Ids are those of the whole text without special tokens around it; texts of
    special tokens within it are those tokens.  Null counts as empty: no
    tokens, hashes of no bytes.  Rows are independent of each other, repeated
    ones give equal rows; an empty table gives none.  Only the compiled table
    of the vocabulary is broadcast.
    """
    spark = docs.sparkSession
    workers_see_package(spark)
    shared = spark.sparkContext.broadcast(model(path))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(shared.value)
        encoder = _ENCODERS[path]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids, labels = encoder.encode(text or "")
                count = ids.count(" ") + 1 if ids else 0
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, labels)]
                row = (doc, count, *digests)
                rows.append((*row, [int(x) for x in ids.split()], labels) if with_tokens else row)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pd.DataFrame(rows, columns=names[: 6 if with_tokens else 4])

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    # identifiers go as text: pandas has no whole numbers with nulls
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(encode, schema + (", ids array<long>, decoded string" if with_tokens else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
