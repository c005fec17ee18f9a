"""Packing of documents into sequences of tokens by bulk-synchronous best fit.

Documents are cut into pieces and range-sorted by length, which gives each a
global rank.  Pieces of one length are interchangeable, and so are equal gaps,
so rounds work on runs of ranks and of sequences; a run is one row, and there
are never more than the capacity allows, however large the corpus is.  A round
matches all documents and gaps at once: two sweeps along the sorted sizes tell
which gaps have a predecessor left and which documents a successor, conflicts
go by rank, and matched runs are paired in order.  Gaps are then updated, and
the next round begins; if nothing matches, the largest documents left open new
sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.bpe import byte_letters
from ledgerlark.llm.common import new_names, numbered, small_batches, small_side, stored, workers_see_package

CAPACITY = 2048
END = 0

#: Bytes of the words, with their ids, that a worker remembers; then it starts anew.
REMEMBERED_BYTES = 32 << 20
#: What Python takes for a word and its ids besides their letters and bytes.
WORD_BYTES = 190
#: Pieces that a worker hands back at a time.
ROWS_BACK = 4096

#: Letters and numbers of the characters up to U+024F, as in the vocabulary's own split.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters only are split here; the others by the library.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)


def ranked(vocabulary: dict[str, int], added: set[int]) -> Callable[[str], list[int]]:
    """Ids of single words by the vocabulary's ranks: its ids follow the order of its merges.

    The same ids as the tokenizer's own, at a small part of its cost for each call.
    """
    import tiktoken

    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if i not in added}
    words = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return words.encode_ordinary


class Words(dict):
    """Words and their ids as bytes; an unknown word is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.bytes = encode, 0

    def __missing__(self, word: str) -> bytes:
        if self.bytes > REMEMBERED_BYTES:
            self.clear()
            self.bytes = 0
        ids = self[word] = array("I", self.encode(word)).tobytes()
        self.bytes += WORD_BYTES + 2 * len(word) + len(ids)
        return ids


class Encoder:
    """Ids of whole texts, as bytes (little-endian unsigned 32-bit), with remembered words.

    The library's own tokenizer is loaded only when a text needs it.
    """

    def __init__(self, path: str):
        self.path = path
        description = json.loads(Path(path).read_text("utf-8"))
        added = {token["content"]: token["id"] for token in description["added_tokens"]}
        self.special = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        parts = "|".join(re.escape(token) for token in sorted(added, key=len, reverse=True))
        self.cut = re.compile(f"({parts})") if added else None
        self.known = Words(ranked(description["model"]["vocab"], set(added.values())))

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            out.extend(map(self.known.__getitem__, WORDS.findall(part)))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of pieces; only the first may be shorter than the capacity."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, tokens, capacity)]


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of all documents, cut to the capacity.

    A document is its ids and then id 0; null counts as empty, which is one
    token.  ``path`` is a tokenizer file that the executors have.
    """
    workers_see_package(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).encode, np.array([END], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<u4").astype("int64")) if with_ids else row)
                    if len(rows) >= ROWS_BACK:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"
    # identifiers go as text: pandas has no whole numbers with nulls
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(cut, schema + (", ids array<long>" if with_ids else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sweeps(documents: DataFrame, gaps: DataFrame) -> DataFrame:
    """Runs of both kinds with ``matched``, and ``place`` of the first match among those of its kind.

    Up along the sizes, a gap is matched while documents that fit are open; down
    along them, a document while gaps are.  A matching that covers both sets
    exists, and then the one that pairs them in order of size does.
    """
    runs = documents.withColumn("gap", F.lit(False)).unionByName(gaps.withColumn("gap", F.lit(True)))
    up = Window.orderBy("size", "gap", "first")
    down = Window.orderBy(F.desc("size"), F.desc("gap"), F.desc("first"))
    here = (Window.unboundedPreceding, Window.currentRow)
    sign = F.when(F.col("gap"), -F.col("n")).otherwise(F.col("n"))
    swept = (
        runs.withColumn("_open", F.sum(sign).over(up.rowsBetween(*here)))
        .withColumn("_alone", -F.least(F.lit(0), F.min("_open").over(up.rowsBetween(*here))))
        .withColumn("_alone", F.col("_alone") - F.lag("_alone", 1, 0).over(up))
        .withColumn("_free", F.sum(-sign).over(down.rowsBetween(*here)))
        .withColumn("_left", -F.least(F.lit(0), F.min("_free").over(down.rowsBetween(*here))))
        .withColumn("_left", F.col("_left") - F.lag("_left", 1, 0).over(down))
        .withColumn("matched", F.col("n") - F.when(F.col("gap"), F.col("_alone")).otherwise(F.col("_left")))
    )
    mine = lambda gap: F.sum(F.when(F.col("gap") == gap, F.col("matched")).otherwise(0)).over(up.rowsBetween(*here))
    return swept.withColumn(
        "place", F.when(F.col("gap"), mine(True)).otherwise(mine(False)) - F.col("matched")
    ).select("size", "first", "n", "gap", "matched", "place")


def _pairs(swept: DataFrame) -> DataFrame:
    """(length, rank, gap, sequence, n): runs of matched documents and gaps side by side."""
    run = F.struct("place", "size", "first")
    starts = (
        swept.where("matched > 0")
        .groupBy("place")
        .agg(F.max(F.when(~F.col("gap"), run)).alias("d"), F.max(F.when(F.col("gap"), run)).alias("g"),
             F.max(F.col("place") + F.col("matched")).alias("reach"))
    )
    order = Window.orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        starts.withColumn("n", F.coalesce(F.lead("place").over(order), last) - F.col("place"))
        .withColumn("d", F.last("d", True).over(so_far))
        .withColumn("g", F.last("g", True).over(so_far))
        .select(
            F.col("d.size").alias("length"),
            (F.col("d.first") + F.col("place") - F.col("d.place")).alias("rank"),
            F.col("g.size").alias("gap"),
            (F.col("g.first") + F.col("place") - F.col("g.place")).alias("sequence"),
            "n",
        )
    )


def best_fit(runs: DataFrame, capacity: int) -> DataFrame:
    """(length, rank, sequence, offset, n) of all document runs (size, first, n).

    ``first`` is the rank of a run's first document in the order of lengths.
    Row i of a placed run is document ``rank + i`` in sequence ``sequence + i``.
    """
    spark = runs.sparkSession
    placed = "length long, rank long, sequence long, offset long, n long"
    large = runs.where(2 * F.col("size") > capacity)
    summary = large.agg(F.min("first").alias("first"), F.sum("n").alias("n")).first()
    start, opened = (summary["first"] or 0), (summary["n"] or 0)
    alone = large.select("size", "first", (F.col("first") - start).alias("sequence"), "n")
    rounds = [alone.select(F.col("size").alias("length"), F.col("first").alias("rank"), "sequence", F.lit(0).cast("long").alias("offset"), "n")]
    documents = runs.where(2 * F.col("size") <= capacity)
    gaps = alone.select((capacity - F.col("size")).alias("size"), F.col("sequence").alias("first"), "n").where("size > 0")
    while True:
        swept = stored(_sweeps(documents, gaps), "packing-sweeps")
        left = F.col("n") - F.col("matched")
        totals = swept.where("not gap").agg(
            F.sum(left).alias("left"),
            F.sum("matched").alias("matched"),
            F.sum(left * F.col("size")).alias("tokens"),
            F.min(F.when(left > 0, F.col("size"))).alias("shortest"),
        ).first()
        rest = swept.where(left > 0).select(
            "size", (F.col("first") + F.col("matched")).alias("first"), left.alias("n"), "gap"
        )
        documents, gaps = rest.where("not gap").drop("gap"), rest.where("gap").drop("gap")
        if totals["matched"]:
            pairs = stored(_pairs(swept), "packing-pairs")
            rounds.append(pairs.select("length", "rank", "sequence", (capacity - F.col("gap")).alias("offset"), "n"))
            gaps = gaps.unionByName(
                pairs.select((F.col("gap") - F.col("length")).alias("size"), F.col("sequence").alias("first"), "n")
            )
        if not totals["left"]:
            break
        if not totals["matched"]:
            wanted = -(-totals["tokens"] // capacity)
            down = Window.orderBy(F.desc("size"), F.desc("first")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ranked = documents.withColumn("_before", F.sum("n").over(down) - F.col("n")).withColumn(
                "_take", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(wanted) - F.col("_before")))
            )
            ranked = stored(ranked, "packing-opened")
            new = ranked.where("_take > 0").select(
                "size", "first", (F.col("_before") + opened).alias("sequence"), F.col("_take").alias("n")
            )
            rounds.append(new.select(F.col("size").alias("length"), F.col("first").alias("rank"), "sequence", F.lit(0).cast("long").alias("offset"), "n"))
            documents = ranked.where("n > _take").select(
                "size", (F.col("first") + F.col("_take")).alias("first"), (F.col("n") - F.col("_take")).alias("n")
            )
            gaps = gaps.unionByName(
                new.select((capacity - F.col("size")).alias("size"), F.col("sequence").alias("first"), "n")
            )
            opened += min(wanted, totals["left"])
        gaps = gaps.where(F.col("size") >= totals["shortest"])
    out = spark.createDataFrame([], placed)
    for part in rounds:
        out = out.unionByName(part)
    return stored(out, "packing-placed")


def packed(rows: DataFrame, order: list[str], capacity: int = CAPACITY, written: bool = False) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; ``rows.length`` is 1 to ``capacity``.

    Rows are sorted by length and then ``order``; equal rows are
    interchangeable.  In each sequence offsets are gapless from 0 and the
    lengths sum to the capacity at most.  Columns of the new names are
    replaced.  ``written`` rows come straight from files and are not written
    again.  An empty input gives no rows.
    """
    plain = rows.drop("sequence_id", "offset")
    rank, own = new_names(plain, "rank", "own_length")
    sorted_rows = numbered(plain, ["length", *order], rank, written)
    runs = stored(
        sorted_rows.groupBy("length").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("length", "size"),
        "packing-runs",
    )
    if not runs.take(1):
        return plain.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    names = {"length": own, "rank": "run_rank", "sequence": "run_sequence", "offset": "offset", "n": "run_n"}
    places = small_side(best_fit(runs, capacity).withColumnsRenamed(names), 40)
    places = places.select(F.col(own), F.struct("run_rank", "run_sequence", "offset", "run_n").alias(f"{own}_run"))
    run = F.col(f"{own}_run")
    within = (F.col("length") == F.col(own)) & (F.col(rank) >= run["run_rank"]) & (
        F.col(rank) < run["run_rank"] + run["run_n"]
    )
    return (
        sorted_rows.join(places, within)
        .withColumn("sequence_id", run["run_sequence"] + F.col(rank) - run["run_rank"])
        .withColumn("offset", run["offset"])
        .select(*plain.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one token long.  Repeated rows are documents of
    their own.  An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, path, capacity), "pieces")  # texts are tokenised once
    return packed(cut, ["doc_id", "piece", "ids_crc32"], capacity, written=True)
