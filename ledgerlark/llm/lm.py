"""Language-model scores: an interpolated modified Kneser-Ney model, counted by Spark.

The model has an order of two or three words.  Tasks count words, then pairs or
triples, of some million tokens at a time; sorted arrays of keys and counts are
shuffled by ranges of hashes and merged into sorted hash arrays, which tasks
write to the shared folder.  The rank of a word's hash among all is its number;
pairs and triples are lists of numbers under the numbers of words before, so
they tell their words.  Workers map the arrays into memory and look numbers up
by binary search; nothing passes the driver but a row for each array.

With order three, counts of triples make the highest level; the pairs below
count the distinct words before them.  A triple is dealt by its middle word, so
contexts (the two words before) and pairs (the last two) are merged where their
triples are.  A middle word with very many tokens is dealt by its neighbours
too; its contexts and pairs are then sums of parts, merged by a second shuffle,
so no task merges a hot word alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import shared_folder, stored, workers_see_package

#: Contract: share of training rows, and what the base score adds to each count.
FOLDS, ADDED = 10, 0.1

#: Tokens that a task counts, or scores, at a time.
FLUSH = 500_000
#: Tokens of the corpus for each merged array, about.
MERGED = 1 << 22
#: Distinct words that a task keeps before it hands their counts on.
KEPT = 1 << 20
#: Tokens of a word beyond which its pairs and triples are dealt by the other words too.
HOT = 1 << 21
#: Followers of a context from which its sums are stored; those of shorter ones are taken when asked for.
LONG = 8
#: Words of the model's n-grams.
ORDER = 3
#: Bytes of a word and the space after it, about: sizes the number of arrays.
WORD_BYTES = 6

#: Hash of the end of a text, which no word has a space for.
END = xxhash.xxh64_intdigest(b" ")
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> Column:
    """Whether a row is not for training; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _spread(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(32))) * MIX
        return (x ^ (x >> np.uint64(29))) * MIX


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def save(folder: str, values: np.ndarray) -> str:
    """Write an array to a new file of the shared folder; its place.  Lost attempts leave no row."""
    from pyarrow import fs

    place = f"{folder}/{uuid.uuid4().hex}.{values.dtype.str[1:]}"
    store, path = fs.FileSystem.from_uri(place)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    return place


def mapped(place: str) -> np.ndarray:
    """The array of a file, mapped into memory; from a remote store by way of a nameless copy."""
    from pyarrow import fs

    kind = np.dtype("<" + place.rsplit(".", 1)[1])
    store, path = fs.FileSystem.from_uri(place)
    size = store.get_file_info(path).size
    if not size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r").view(np.ndarray)
    copy = tempfile.TemporaryFile()
    with store.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
    copy.flush()
    return np.memmap(copy, kind, "r").view(np.ndarray)


@dataclass
class Vocabulary:
    """Sorted word hashes and counts, in arrays by the first bits of the hash."""

    bits: int
    places: list[tuple[str, str]]
    sizes: list[int]
    arrays: list = field(default_factory=list, compare=False)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def open(self) -> Vocabulary:
        if not self.arrays:
            self.arrays = [tuple(map(mapped, pair)) for pair in self.places]
        return self

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count or 0) of each hash."""
        numbers = np.full(len(hashes), -1, np.int64)
        counts = np.zeros(len(hashes), np.int64)
        for bucket, rows in _by_bucket(_high(hashes, self.bits)):
            keys, values = self.arrays[bucket]
            at, found = _find(keys, hashes[rows])
            numbers[rows[found]] = at[found] + self.starts[bucket]
            counts[rows[found]] = values[at[found]]
        return numbers, counts

    def per_number(self, numbers: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
        """Rows of ``arrays`` (one for each range of numbers) for valid numbers."""
        out = np.zeros((len(numbers), *arrays[0].shape[1:]), np.int64)
        ranges = np.searchsorted(self.starts[1:-1], numbers, side="right")
        for bucket, rows in _by_bucket(ranges):
            out[rows] = arrays[bucket][numbers[rows] - self.starts[bucket]]
        return out


def _high(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows) of each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    values, first = np.unique(buckets[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, first[1:])):
        yield value, rows


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Tokens:
    """Some documents as numbers of distinct words: ``codes`` of all tokens, an end after each text."""

    hashes: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, Tokens]]:
    """(number of texts, their tokens) of consecutive texts with about ``FLUSH`` tokens."""
    words: list[bytes] = []
    lengths: list[int] = []
    for i, text in enumerate(texts):
        own = words_of(text)
        words += own
        words.append(b" ")
        lengths.append(len(own) + 1)
        if len(words) >= FLUSH or i + 1 == len(texts):
            codes, distinct = pd.factorize(np.array(words, dtype=object))
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(word) for word in distinct), np.uint64, len(distinct))
            yield len(lengths), Tokens(hashes, codes, np.array(lengths))
            words, lengths = [], []


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, by place within the number: upper bytes of word numbers are few."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).data, 1)


def unpacked(parts: Iterable[bytes], kind: type) -> np.ndarray:
    """All numbers of ``parts``."""
    size = np.dtype(kind).itemsize
    raw = (np.frombuffer(zstandard.decompress(part), np.uint8).reshape(size, -1).T for part in parts)
    found = [np.ascontiguousarray(planes).view(kind).reshape(-1) for planes in raw]
    return np.concatenate(found) if found else np.zeros(0, kind)


def count_words(docs: DataFrame, bits: int, folder: str) -> DataFrame:
    """(bucket, keys, counts, size, total) of the merged vocabulary arrays of ``docs.text``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(hashes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame(
                [(bucket, packed(hashes[own]), packed(counts[own])) for bucket, own in _by_bucket(_high(hashes, bits))],
                columns=["bucket", "keys", "counts"],
            )

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, tokens in batches_of(batch["text"].tolist()):
                kept.append((tokens.hashes, np.bincount(tokens.codes, minlength=len(tokens.hashes)).astype(np.uint64)))
                if sum(len(hashes) for hashes, _ in kept) > 2 * KEPT:
                    kept = [_summed(*map(np.concatenate, zip(*kept)))]
                    if len(kept[0][0]) > KEPT:
                        yield rows(*kept.pop())
        if kept:
            yield rows(*_summed(*map(np.concatenate, zip(*kept))))

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(unpacked(parts["keys"], np.uint64), unpacked(parts["counts"], np.uint64))
        row = (key[0], save(folder, keys), save(folder, narrow(counts)), len(keys), int(counts.sum()))
        return pd.DataFrame([row], columns=["bucket", "keys", "counts", "size", "total"])

    counted = docs.select("text").mapInPandas(count, "bucket long, keys binary, counts binary")
    return counted.groupBy("bucket").applyInPandas(
        merge, "bucket long, keys string, counts string, size long, total long"
    )


def dealt(word: np.ndarray, others: np.ndarray, count: np.ndarray, bits: int, hot: int) -> np.ndarray:
    """The bucket of n-grams of a word, met ``count`` times; those of words met ``hot`` times or more
    are dealt by a hash of the other words too, and have buckets of their own behind the rest."""
    parts = (count // hot + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        buckets = _high(_spread(word.astype(np.uint64) + (_spread(others.astype(np.uint64)) % parts) * MIX), bits)
    return buckets + ((parts > 1).astype(np.int64) << bits)


def _both(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _spread(before.astype(np.uint64)) + after.astype(np.uint64)


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted ``columns`` begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _totals(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def _kinds(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each group of counts: their sum, and how many are 1, 2 and more."""
    columns = [counts, counts == 1, counts == 2, counts > 2]
    return np.stack([_totals(column.astype(np.int64), begins) for column in columns], axis=1)


def save_counts(folder: str, counts: np.ndarray) -> list[str]:
    """Counts in a byte each; places and values of those that need more."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return [save(folder, x) for x in (small, large.astype(np.uint64), counts[large].astype(np.int64))]


def read_counts(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    small, places, values = arrays
    counts = small[at].astype(np.int64)
    large = np.flatnonzero(counts == 255)
    counts[large] = values[np.searchsorted(places, at[large].astype(np.uint64))]
    return counts


def save_lists(folder: str, heads: np.ndarray, items: np.ndarray) -> list[str]:
    """Sorted (head, item) as distinct heads, where their lists begin, and the items."""
    begins = _begins(heads)
    starts = np.append(begins, len(heads))
    return [save(folder, x) for x in (heads[begins].astype(np.uint32), narrow(starts), items.astype(np.uint32))]


def seek(arrays: list[np.ndarray], heads: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of (head, item) pairs in lists."""
    known, starts, listed = arrays
    if not len(listed):
        return np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)
    head, found = _find(known, heads.astype(np.uint32))
    low = np.where(found, starts[head], 0).astype(np.int64)
    return within(listed, low, np.where(found, starts[head + 1], 0).astype(np.int64), items)


def within(listed: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each wanted item in its own sorted part of ``listed``."""
    length = high - low
    steps = np.frexp(np.maximum(length - 1, 0))[1].astype(np.int16)
    order = np.argsort(-steps, kind="stable")  # those with steps left stay in front
    at, length, item = low[order], length[order], wanted[order]
    with_steps = np.bincount(steps).cumsum() if len(steps) else np.zeros(1, np.int64)
    for done in with_steps[:-1].tolist() if len(with_steps) else []:
        n = len(order) - done
        half = length[:n] >> 1
        at[:n] += half * (listed[at[:n] + half - 1] < item[:n])
        length[:n] -= half
    there = np.flatnonzero(length)
    places, found = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    places[order] = at
    found[order[there]] = listed[at[there]] == item[there]
    return places, found


@dataclass(frozen=True)
class Context:
    """Numbers of all tokens of some documents and of the words before them; begin is the size of the vocabulary."""

    before: np.ndarray
    first: np.ndarray
    second: np.ndarray
    first_count: np.ndarray
    second_count: np.ndarray


def in_context(tokens: Tokens, vocabulary: Vocabulary, texts: int) -> Context:
    numbers, counts = vocabulary.numbers(tokens.hashes)
    second, second_count = numbers[tokens.codes], counts[tokens.codes]
    starts = np.concatenate(([0], np.cumsum(tokens.lengths)[:-1]))

    def shifted(values: np.ndarray, at_start: int) -> np.ndarray:
        out = np.concatenate((values[:1], values[:-1]))
        out[starts] = at_start
        return out

    first = shifted(second, vocabulary.size)
    return Context(shifted(first, vocabulary.size), first, second, shifted(second_count, texts), second_count)


#: Rows that merges give: arrays by bucket, and parts for a second merge.
MERGED_ROWS = "kind string, bucket long, places array<string>, size long, often array<long>, part array<binary>"


def _row(kind: str, bucket: int, places=None, size: int = 0, often=None, part=None) -> tuple:
    return kind, bucket, places, size, often, None if part is None else [packed(x) for x in part]


def _often(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _pair_rows(bucket: int, keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, folder: str) -> Iterator[tuple]:
    """The array of complete pairs, and what their words have as first and as second."""
    first, second = _halves(keys)
    places = save_lists(folder, first, second) + save_counts(folder, counts)
    yield _row("pairs", bucket, places, len(keys), _often(counts))
    begins = _begins(first)
    words, met = np.unique(second, return_counts=True)
    for kind, numbers, values in (("first", first[begins], _kinds(counts, begins)), ("second", words, met[:, None])):
        for own, rows in _by_bucket(np.searchsorted(starts[1:-1], numbers, side="right")):
            yield _row(kind, own, part=[numbers[rows], *values[rows].astype(np.uint64).T])


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["kind", "bucket", "places", "size", "often", "part"])


def count_pairs(docs: DataFrame, vocabulary: Vocabulary, texts: int, bits: int, hot: int, folder: str) -> DataFrame:
    """MERGED_ROWS of the pairs of ``docs.text``, with their numbers of occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary.open()
        for batch in batches:
            for _, tokens in batches_of(batch["text"].tolist()):
                c = in_context(tokens, vocabulary, texts)
                keys, once, counts = np.unique(_key(c.first, c.second), return_index=True, return_counts=True)
                first, second = _halves(keys)
                buckets = dealt(first, second, c.first_count[once], bits, hot)
                yield pd.DataFrame(
                    [(bucket, *map(packed, (keys[own], counts[own].astype(np.uint64)))) for bucket, own in _by_bucket(buckets)],
                    columns=["bucket", "keys", "counts"],
                )

    starts = vocabulary.starts

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(unpacked(parts["keys"], np.uint64), unpacked(parts["counts"], np.uint64))
        return _frame(_pair_rows(key[0], keys, counts, starts, folder))

    counted = docs.select("text").mapInPandas(count, "bucket long, keys binary, counts binary")
    return counted.groupBy("bucket").applyInPandas(merge, MERGED_ROWS)


def count_triples(docs: DataFrame, vocabulary: Vocabulary, texts: int, bits: int, hot: int, folder: str) -> DataFrame:
    """MERGED_ROWS of the triples of ``docs.text`` and their pairs; parts of what hot middle words have."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary.open()
        for batch in batches:
            for _, tokens in batches_of(batch["text"].tolist()):
                c = in_context(tokens, vocabulary, texts)
                context = _key(c.first, c.before)
                order = np.lexsort((c.second, context))
                context, last = context[order], c.second[order].astype(np.uint32)
                begins = _begins(context, last)
                counts = np.diff(np.append(begins, len(order))).astype(np.uint32)
                context, last, met = context[begins], last[begins], c.first_count[order[begins]]
                middle, before = _halves(context)
                buckets = dealt(middle, _both(before, last), met, bits, hot)
                yield pd.DataFrame(
                    [
                        (bucket, *(packed(x[own]) for x in (middle, before, last, counts)), *spread)
                        for bucket, own in _by_bucket(buckets)
                        for spread in [_hot_parts(met[own], middle[own]) if bucket >> bits else (None, None)]
                    ],
                    columns=["bucket", "middle", "before", "last", "counts", "hot", "met"],
                )

    starts = vocabulary.starts

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        bucket = key[0]
        middle, before, last, counts = (unpacked(parts[c], np.uint32) for c in ("middle", "before", "last", "counts"))
        context = _key(middle, before)
        order = np.lexsort((last, context))
        context, last, counts = context[order], last[order], counts[order].astype(np.uint64)
        begins = _begins(context, last)
        context, last, counts = context[begins], last[begins], _totals(counts, begins)
        begins = _begins(context)
        middle, before = _halves(context)
        pairs, before_pair = np.unique(_key(middle, last), return_counts=True)
        sums, long = _kinds(counts, begins), np.flatnonzero(np.diff(np.append(begins, len(context))) >= LONG)
        places = save_lists(folder, middle[begins], before[begins])
        places += [save(folder, x) for x in (np.append(begins, len(context)).astype(np.uint32), last)]
        places += save_counts(folder, counts)
        places += [save(folder, x) for x in (long.astype(np.uint32), narrow(sums[long]).reshape(-1))]
        rows = [_row("triples", bucket, places, len(context), _often(counts))]
        if not bucket >> bits:
            return _frame([*rows, *_pair_rows(bucket, pairs, before_pair, starts, folder)])
        # hot middle words: other buckets have some of these contexts and pairs too
        words, first = np.unique(unpacked(parts["hot"], np.uint32), return_index=True)
        met = unpacked(parts["met"], np.uint64)[first]
        for kind, keys, values in (("context", context[begins], sums), ("pair", pairs, before_pair[:, None])):
            head, item = _halves(keys)
            for own, at in _by_bucket(dealt(head, item, met[np.searchsorted(words, head)], bits, hot)):
                rows.append(_row(kind, own, part=[keys[at], *values[at].astype(np.uint64).T]))
        return _frame(rows)

    counted = docs.select("text").mapInPandas(
        count,
        "bucket long, middle binary, before binary, last binary, counts binary, hot binary, met binary",
    )
    return counted.groupBy("bucket").applyInPandas(merge, MERGED_ROWS)


def _hot_parts(met: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct hot words and their numbers of tokens, which the merge deals by."""
    begins = _begins(words)
    return packed(words[begins]), packed(met[begins].astype(np.uint64))


def merge_hot(parts: DataFrame, vocabulary: Vocabulary, folder: str) -> DataFrame:
    """MERGED_ROWS of contexts and pairs of hot words, from parts of the merge of triples."""
    starts = vocabulary.starts

    def merge(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = key
        keys, *values = (unpacked(column, np.uint64) for column in zip(*own["part"]))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = _begins(keys)
        values = [_totals(column[order], begins) for column in values]
        if kind == "pair":
            return _frame(_pair_rows(bucket, keys[begins], values[0], starts, folder))
        places = save_lists(folder, *_halves(keys[begins]))
        places.append(save(folder, narrow(np.stack(values, axis=1)).reshape(-1)))
        return _frame([_row("contexts", bucket, places, len(begins))])

    return parts.groupBy("kind", "bucket").applyInPandas(merge, MERGED_ROWS)


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in 32 bits if they fit, else 64."""
    return values.astype(np.uint32 if not values.size or values.max() < 1 << 32 else np.uint64)


#: What is kept of a word: distinct words before it; the sum of its pairs as first, and how many of them count 1, 2 and more.
COLUMNS = 5


def merge_statistics(parts: DataFrame, vocabulary: Vocabulary, folder: str) -> DataFrame:
    """(bucket, place, often) of arrays with ``COLUMNS`` numbers for each word."""
    starts = vocabulary.starts

    def merge(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        bucket = key[0]
        begin, end = int(starts[bucket]), int(starts[bucket + 1]) + (bucket + 2 == len(starts))
        out = np.zeros((end - begin, COLUMNS), np.uint64)
        for kind, (numbers, *values) in zip(own["kind"], own["part"]):
            rows = unpacked([numbers], np.uint32).astype(np.int64) - begin
            columns = slice(1, None) if kind == "first" else slice(0, 1)
            out[rows, columns] += np.stack([unpacked([column], np.uint64) for column in values], axis=1)
        row = (bucket, save(folder, narrow(out).reshape(-1)), _often(out[:, 0]))
        return pd.DataFrame([row], columns=["bucket", "place", "often"])

    return parts.groupBy("bucket").applyInPandas(merge, "bucket long, place string, often array<long>")


def discounts(often: list[int]) -> list[float]:
    """What modified Kneser-Ney takes from counts of 0, 1, 2 and more; within 0 and the count
    where so few counts exist that the estimate is undefined."""
    n1, n2, n3, n4 = often
    basis = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    ratios = [(n2, n1), (n3, n2), (n4, n3)]
    found = [k - (k + 1) * basis * (above / here if here else 0.5) for k, (above, here) in enumerate(ratios, 1)]
    return [0.0, *[min(max(value, 0.0), float(k)) for k, value in enumerate(found, 1)]]


Places = dict[int, list[str]]


@dataclass
class Model:
    """Where the arrays are, and the totals; ``open`` maps them."""

    order: int
    vocabulary: Vocabulary
    bits: int
    hot: int
    pairs: Places
    triples: Places
    contexts: Places
    statistics: list[str]
    tokens: int
    texts: int
    distinct_pairs: int
    of_triples: list[float]
    of_pairs: list[float]
    of_words: list[float]
    words_often: list[int]
    arrays: dict[str, dict[int, list]] = field(default_factory=dict, compare=False)
    rows: list = field(default_factory=list, compare=False)

    def open(self) -> Model:
        if not self.rows:
            self.vocabulary.open()
            for name in ("pairs", "triples", "contexts"):
                self.arrays[name] = {b: [mapped(x) for x in places] for b, places in getattr(self, name).items()}
            self.rows = [mapped(place).reshape(-1, COLUMNS) for place in self.statistics]
        return self

    def in_buckets(self, name: str, buckets: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
        for bucket, rows in _by_bucket(buckets):
            if bucket in self.arrays[name]:
                yield self.arrays[name][bucket], rows

    def word_probabilities(self, second: np.ndarray) -> np.ndarray:
        """By the distinct words before a word, and the share of unknown ones."""
        discount, pairs, known = np.array(self.of_words), max(self.distinct_pairs, 1), second >= 0
        before = np.zeros(len(second), np.int64)
        before[known] = self.vocabulary.per_number(second[known], self.rows)[:, 0]
        spare = sum(d * n for d, n in zip(discount[1:], self.words_often)) / pairs if self.distinct_pairs else 1.0
        return np.maximum(before - discount[np.minimum(before, 3)], 0) / pairs + spare / (self.vocabulary.size + 1)

    def pair_probabilities(self, c: Context) -> np.ndarray:
        """Of each word after the word before it."""
        known = np.flatnonzero((c.first >= 0) & (c.second >= 0))
        context = np.flatnonzero(c.first >= 0)
        sums = np.zeros((len(c.first), COLUMNS - 1), np.int64)
        sums[context] = self.vocabulary.per_number(c.first[context], self.rows)[:, 1:]
        counts = np.zeros(len(c.first), np.int64)
        buckets = dealt(c.first[known], c.second[known], c.first_count[known], self.bits, self.hot)
        for arrays, rows in self.in_buckets("pairs", buckets):
            rows = known[rows]
            at, found = seek(arrays[:3], c.first[rows], c.second[rows])
            counts[rows[found]] = read_counts(arrays[3:6], at[found])
        return interpolated(counts, sums, self.of_pairs, self.word_probabilities(c.second))

    def triple_probabilities(self, c: Context) -> np.ndarray:
        """Of each word after the two words before it; in any order, fastest if sorted by these."""
        known = np.flatnonzero((c.before >= 0) & (c.first >= 0))
        counts = np.zeros(len(c.first), np.int64)
        sums = np.zeros((len(c.first), COLUMNS - 1), np.int64)
        buckets = dealt(c.first[known], _both(c.before[known], c.second[known]), c.first_count[known], self.bits, self.hot)
        for arrays, rows in self.in_buckets("triples", buckets):
            cold, rows = c.first_count[known[rows[0]]] < self.hot, known[rows]
            begins = _begins(c.first[rows], c.before[rows])  # rows come sorted by their contexts
            each = np.diff(np.append(begins, len(rows)))
            context, found = seek(arrays[:3], c.first[rows[begins]], c.before[rows[begins]])
            context, each, rows = context[found], each[found], rows[np.repeat(found, each)]
            starts, last, *numbers, long, long_sums = arrays[3:]
            low, high = starts[context].astype(np.int64), starts[context + 1].astype(np.int64)
            at, met = within(last, np.repeat(low, each), np.repeat(high, each), c.second[rows])
            counts[rows[met]] = read_counts(numbers, at[met])
            if not cold:
                continue
            own = np.zeros((len(context), COLUMNS - 1), np.int64)
            row, kept = _find(long, context.astype(np.uint32))
            own[kept] = long_sums.reshape(-1, COLUMNS - 1)[row[kept]]
            for k in range(LONG):
                more = np.flatnonzero(~kept & (low + k < high))
                met = read_counts(numbers, low[more] + k)
                own[more] += np.stack([met, met == 1, met == 2, met > 2], axis=1)
            sums[rows] = np.repeat(own, each, axis=0)
        hot = known[c.first_count[known] >= self.hot]
        for (*lists, values), rows in self.in_buckets(
            "contexts", dealt(c.first[hot], c.before[hot], c.first_count[hot], self.bits, self.hot)
        ):
            rows = hot[rows]
            at, found = seek(lists, c.first[rows], c.before[rows])
            sums[rows[found]] = values.reshape(-1, COLUMNS - 1)[at[found]]
        return interpolated(counts, sums, self.of_triples, self.pair_probabilities(c))

    def log_probabilities(self, c: Context) -> np.ndarray:
        """log10 of each word in its context; numbers are -1 for unknown words."""
        return np.log10(self.triple_probabilities(c) if self.order == 3 else self.pair_probabilities(c))


def interpolated(counts: np.ndarray, sums: np.ndarray, discount: list[float], lower: np.ndarray) -> np.ndarray:
    """Discounted shares of a context's counts, and what that leaves by the level below; ``sums``
    has the sum of a context's counts and how many are 1, 2 and more, all 0 if it is unknown."""
    discounted, total = np.array(discount), np.maximum(sums[:, 0], 1)
    left = np.where(sums[:, 0] > 0, (sums[:, 1:] * discounted[1:]).sum(axis=1) / total, 1.0)
    return np.maximum(counts - discounted[np.minimum(counts, 3)], 0) / total + left * lower


def trained(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> Model:
    """The model of ``docs.text``; an empty table gives a model that knows no word."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    workers_see_package(spark)
    folder = shared_folder(spark, "lm-arrays")
    size = docs.agg(F.sum(F.octet_length("text") / WORD_BYTES + 1).alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    bits = max(3, int(np.ceil(np.log2(max(size["tokens"] or 1, 1) / MERGED))))
    rows = {row["bucket"]: row for row in stored(count_words(docs, bits, folder), "lm-words").collect()}
    empty = [save(folder, np.zeros(0, kind)) for kind in ("<u8", "<u8")]
    buckets = range(1 << bits)
    vocabulary = Vocabulary(
        bits,
        [(rows[b]["keys"], rows[b]["counts"]) if b in rows else tuple(empty) for b in buckets],
        [rows[b]["size"] if b in rows else 0 for b in buckets],
    )
    if vocabulary.size >= 2**32 - 1:
        raise ValueError("words are numbered with 32 bits")
    count = count_triples if order == 3 else count_pairs
    parts = stored(count(docs, vocabulary, size["n"], bits, hot, folder), "lm-counts")
    of_hot = F.col("kind").isin("context", "pair")
    if order == 3:
        parts = parts.where(~of_hot).unionByName(stored(merge_hot(parts.where(of_hot), vocabulary, folder), "lm-hot"))
    arrays = parts.where(F.col("places").isNotNull()).drop("part").collect()
    merged = merge_statistics(parts.where(F.col("kind").isin("first", "second")), vocabulary, folder)
    statistics = {row["bucket"]: row for row in stored(merged, "lm-statistics").collect()}
    words_often = [sum(row["often"][k] for row in statistics.values()) for k in range(4)]
    of = {kind: [row for row in arrays if row["kind"] == kind] for kind in ("triples", "pairs", "contexts")}
    often = {kind: [sum(row["often"][k] for row in of[kind]) for k in range(4)] for kind in ("triples", "pairs")}
    # words met before by three or more different ones take the last discount
    more = vocabulary.size - sum(words_often[:2])
    places = [
        statistics[b]["place"] if b in statistics
        else save(folder, np.zeros(COLUMNS * (n + (b + 1 == len(buckets))), "<u4"))
        for b, n in enumerate(vocabulary.sizes)
    ]
    return Model(
        order, vocabulary, bits, hot, *({row["bucket"]: row["places"] for row in of[kind]} for kind in ("pairs", "triples", "contexts")),
        places, sum(row["total"] for row in rows.values()), size["n"], sum(row["size"] for row in of["pairs"]),
        discounts(often["triples"]), discounts(often["pairs"]), discounts(words_often), [*words_often[:2], more],
    )


_OPENED: dict[str, Model] = {}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out`` and the scores of whole ``docs.text`` under the model."""
    workers_see_package(docs.sparkSession)
    name = uuid.uuid4().hex
    total, size = model.tokens, model.vocabulary.size

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _OPENED:
            _OPENED.clear()
            _OPENED[name] = model.open()
        own = _OPENED[name]
        for batch in batches:
            done = 0
            for n, tokens in batches_of(batch["text"].tolist()):
                c = in_context(tokens, own.vocabulary, own.texts)
                context = _key(c.first + 1, c.before + 1 if own.order == 3 else np.zeros(len(c.first)))
                order = np.lexsort((c.second, context))
                begins = _begins(context[order], c.second[order])
                once = order[begins]
                distinct = Context(*(x[once] for x in (c.before, c.first, c.second, c.first_count, c.second_count)))
                logs = np.empty(len(order))
                logs[order] = np.repeat(own.log_probabilities(distinct), np.diff(np.append(begins, len(order))))
                base = np.log10((c.second_count + ADDED) / (total + ADDED * (size + 1)))
                text = np.repeat(np.arange(n), tokens.lengths)
                part = batch.iloc[done : done + n]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "held_out": part["held_out"],
                    "n_tokens": tokens.lengths,
                    "n_known": np.bincount(text, c.second_count > 0, n).astype(np.int64),
                    "train_tokens": total,
                    "base_score": np.bincount(text, base, n),
                    "score": np.bincount(text, logs, n),
                })
                done += n

    # identifiers go as text: pandas has no whole numbers with nulls
    out = docs.select(F.col("doc_id").cast("string"), "held_out", "text").mapInPandas(
        score,
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot: int = HOT
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity.

    Trained on the rows that are not held out, with n-grams of ``order`` (2 or 3) words;
    words met ``hot`` times or more are merged in parts.  Null, empty and blank texts are
    one token, the end.  Repeated rows count and are scored each.  An empty
    table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    model = trained(rows.where(~F.col("held_out")), order, hot)
    return scored(rows, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
