"""Reproducible shuffle and shards: a Feistel permutation over global row numbers.

Rows are numbered in a fixed order, the number is permuted, and shard and slot
follow from the permuted number alone.  Whoever knows the row count and the
seed can compute where row ``i`` lies, and which row lies at a place, without
reading anything (``place_of``, ``row_at``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import new_names, numbered, workers_see_package

ROUNDS = 6

#: Multipliers of the 64-bit finalizer published as SplitMix64.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15
WORD = 2**64


def _half_bits(rows: int) -> int:
    """Bits of each half; the domain 4**bits is at least the rows and under four times them."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = half + np.uint64(key % WORD)
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _network(values: np.ndarray, bits: int, keys: list[int], backwards: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & mask
    for key in reversed(keys) if backwards else keys:
        if backwards:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << np.uint64(bits)) | right


def permuted(values: np.ndarray, rows: int, seed: int, backwards: bool = False) -> np.ndarray:
    """A bijection of 0..rows-1, or its inverse; numbers outside walk on along their cycle."""
    bits = _half_bits(rows)
    keys = [(seed + 1) * STEP + round_ * round_ * STEP for round_ in range(1, ROUNDS + 1)]
    out = np.asarray(values, dtype=np.uint64)
    out = _network(out, bits, keys, backwards)
    while (outside := out >= np.uint64(rows)).any():
        out[outside] = _network(out[outside], bits, keys, backwards)
    return out


def place_of(row: int, rows: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    place = int(permuted(np.array([row]), rows, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The row number at a place: the inverse of ``place_of``."""
    return int(permuted(np.array([slot * shards + shard]), rows, seed, backwards=True)[0])


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``.

    Counts of shards differ by one at most (law ``rows``); slots are gapless
    from 0.  The result depends on the rows and the seed, not on files or
    splits: rows are numbered by ``order``, nulls first.  Rows equal in all of
    ``order`` are interchangeable; each gets a place of its own.  Columns of
    the same names are replaced.  An empty input gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = rows.sparkSession
    workers_see_package(spark)
    plain = rows.drop("row_number", "shard", "slot")
    counted = numbered(plain, order, "row_number")
    total = counted.count()

    @F.pandas_udf("long")
    def permute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permuted(batch.to_numpy(), total, seed).astype(np.int64))

    place = new_names(counted, "permuted")[0]
    return (
        counted.withColumn(place, permute("row_number"))
        .withColumn("shard", (F.col(place) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(place) / shards))
        .drop(place)
    )


def shard_documents(
    docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Places of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has none and the
    CRC of no bytes, 0.  Only identifier, size and CRC move; texts stay where
    they are.  Rows are ordered by identifier, CRC and size, so repeated rows
    (equal texts) and null identifiers need no special case.  The law binds
    row counts, so equal texts may lie in different shards; ``grown_shard`` is
    null as it belongs to the law ``key``.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
