"""Near duplicates by SimHash: exact tiled comparison of all fingerprints.

Distinct fingerprints are dealt into tiles whose members have equal population
counts in the upper and in the lower half.  Two tiles are compared only if
these counts differ by no more than the radius in sum, since each differing
bit changes one count by one.  A comparison is numpy exclusive-or and bit count
over all members, so no link is lost.  It gives links of a spanning forest of
its tiles, never all pairs of a group; links are then joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, apart, located, small_side, stored, workers_see_package

#: Contract of the near-duplicate stage.
SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42

#: Fingerprints of a tile, about; 256 KB.  Sizes a comparison, decides no result.
TILE = 1 << 15
#: Fingerprints of one tile that are compared at a time with the other tile.
STRIPE = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
#: Comparisons of two fingerprints in one task, about; some seconds.
TASK_COMPARISONS = 1 << 30


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text, as unsigned number.

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    shingles count as often as they occur.  Fewer words than a shingle: all of
    them are one.  No word (null, empty or blank text): 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(parts) - words + 1)
    width = min(words, len(parts))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for first in range(0, count, BLOCK):
        last = min(first + BLOCK, count)
        hashes = np.fromiter(
            (
                digest(view[a:b], SEED)
                for a, b in zip(
                    starts[first:last].tolist(),
                    ends[first + width - 1 : last + width - 1].tolist(),
                )
            ),
            dtype=">u8",
            count=last - first,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str, name: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint as (signed) long column ``name``."""
    workers_see_package(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = np.array([fingerprint(text, words) for text in batch], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.withColumn(name, fingerprints(text))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links within ``left``, or between ``left`` and ``right``.

    ``right`` None: links within ``left``.  Every link's ends are connected by
    the edges; there are fewer edges than fingerprints.
    """
    members = left if right is None else np.concatenate((left, right))
    shift = 0 if right is None else len(left)
    other = left if right is None else right
    left, other = left.view(np.uint64), other.view(np.uint64)  # bit counts are of absolute values
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for first in range(0, len(left), STRIPE):
        near = np.bitwise_count(left[first : first + STRIPE, None] ^ other[None, :]) <= radius
        rows, columns = np.nonzero(near)
        for a, b in zip((rows + first).tolist(), (columns + shift).tolist()):
            if a != b and (x := root(a)) != (y := root(b)):
                parent[y] = x
                edges.append((members[a].item(), members[b].item()))
    return edges


def links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``values.value`` within ``radius``.

    ``values`` has distinct fingerprints.  Tiles: (upper count, lower count,
    salt); the salt splits a frequent pair of counts into tiles of about
    ``tile`` members by a hash, so no tile grows with the data.  There are at
    most 33 x 33 pairs of counts, whatever the size of the corpus; only that
    table is broadcast.
    """
    spark = values.sparkSession
    workers_see_package(spark)
    low = F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))
    counted = values.select(
        "value",
        F.bit_count(F.shiftrightunsigned("value", 32)).alias("upper"),
        F.bit_count(low).alias("lower"),
    )
    cells = counted.groupBy("upper", "lower").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("salts")
    )
    tiles = (
        counted.join(F.broadcast(cells), ["upper", "lower"])
        .withColumn("salt", F.pmod(F.xxhash64("value"), "salts").cast("int"))
        .groupBy("upper", "lower", "salt")
        .agg(F.collect_list("value").alias("members"))
    )
    tiles = stored(tiles, "tiles")
    keys = tiles.select("upper", "lower", "salt", F.size("members").alias("n"))
    steps = F.array(
        *[
            F.struct(F.lit(up).alias("up"), F.lit(down).alias("down"))
            for up in range(-radius, radius + 1)
            for down in range(abs(up) - radius, radius - abs(up) + 1)
        ]
    )

    def key(side: str) -> Column:
        return F.struct(*[F.col(f"{name}{side}") for name in ("upper", "lower", "salt")])

    wanted = keys.select("*", F.explode(steps).alias("step")).select(
        "upper",
        "lower",
        "salt",
        "n",
        (F.col("upper") + F.col("step.up")).alias("upper_b"),
        (F.col("lower") + F.col("step.down")).alias("lower_b"),
    )
    others = keys.toDF("upper_b", "lower_b", "salt_b", "n_b")
    pairs = stored(
        wanted.join(others, ["upper_b", "lower_b"]).where(key("_b") >= key("")), "tile_pairs"
    )
    work = pairs.agg(F.sum(F.col("n").cast("double") * F.col("n_b"))).first()[0] or 0
    tasks = int(min(100_000, 1 + work // TASK_COMPARISONS))
    second = tiles.select(
        F.col("upper").alias("upper_b"),
        F.col("lower").alias("lower_b"),
        F.col("salt").alias("salt_b"),
        F.col("members").alias("members_b"),
    )
    compared = (
        pairs.withColumn("same", key("") == key("_b"))
        .join(tiles, ["upper", "lower", "salt"])
        .join(second, ["upper_b", "lower_b", "salt_b"])
        .select("members", "members_b", "same")
        .repartition(tasks)
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right, same in zip(batch.members, batch.members_b, batch.same):
                left = np.asarray(left, dtype=np.int64)
                found += forest(left, None if same else np.asarray(right, dtype=np.int64), radius)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compared.mapInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(value, root) of all ends of ``edges`` (a, b); root is the smallest end of the component.

    Each end in turn takes the smallest root of its neighbours, and each root
    the smallest root that any of its members has found; paths thus shrink by
    more than half a round.  Each round is written to the shared folder.
    Minima are taken before the shuffle, so an end with very many links is one
    row for each task.
    """
    both = stored(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("value")).agg(
            F.least(F.col("value"), F.min("b")).alias("root")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("value").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("value"))
            .agg(F.min("root").alias("near"))
        )
        hooked = stored(labels.join(near, "value").select("value", "root", F.least("root", "near").alias("near")), "hooked")
        best = hooked.groupBy("root").agg(F.min("near").alias("best"))
        jump = best.select(F.col("root").alias("best"), F.col("best").alias("beyond"))
        lowest = best.join(jump, "best", "left").select(
            "root", F.least("best", F.coalesce("beyond", "best")).alias("lowest")
        )
        following = stored(
            hooked.join(lowest, "root").select("value", F.least("near", "lowest").alias("root"), (F.least("near", "lowest") != F.col("root")).alias("moved")),
            "labels",
        )
        if not following.where("moved").take(1):
            return following.select("value", "root")
        labels = following.select("value", "root")


@apart
def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Components join documents whose fingerprints differ in ``radius`` bits or
    fewer, over any number of steps; ``component_id`` is the smallest doc_id of
    the component (null only if all are null).  Null, empty and blank texts
    have fingerprint 0 and link like any other.  Copies meet as one
    fingerprint.  An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    prints = stored(with_fingerprints(narrow, "_text", "value", words).drop("_text"), "fingerprints")
    return prints.join(classes(prints, radius), "value").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(value, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, value)."""
    distinct = stored(prints.groupBy("value").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct.select("value"), radius))
    grouped = distinct.join(linked, "value", "left").withColumn("root", F.coalesce("root", "value"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "root").select("value", "root", "component_id")


@apart
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, nulls last, first in place.

    All columns stay.  Only places and fingerprints are joined; texts move only
    if the places of rows that go are too many to broadcast.
    """
    rows = located(docs)
    narrow = rows.select(*PLACE, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    prints = stored(with_fingerprints(narrow, "_text", "value").drop("_text"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *PLACE)
    grouped = stored(prints.join(classes(prints).select("value", "root"), "value").select("root", rank.alias("rank")), "components")
    stays = grouped.groupBy("root").agg(F.min("rank").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = stored(
        grouped.join(stays, "root").where(~F.col("rank").eqNullSafe(F.col("stays"))).select(*[f"rank.{name}" for name in PLACE]), "near-copies"
    )
    return rows.join(small_side(gone, 16), PLACE, "left_anti").select(*docs.columns)
