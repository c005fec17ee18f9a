"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests.  Paths are range-partitioned
and sorted, so the members of a node stand side by side, and a node that
crosses the border of two shards is a prefix of the path at that border.  Those
splitter paths form a small trie, the skeleton, which is broadcast.  Each shard
walks its sorted paths with a stack and finishes every other node alone; of
skeleton nodes it gives partial aggregates, which are then reduced, from the
deepest skeleton node up.

Long conversations are cut into segments of ``SEGMENT`` turns.  A segment is a
path below the node that ends the segment before, which a digest of all turns
so far names.  So splitters, groups and stacks have a bounded depth however
long a conversation is.  Segments that one conversation has to itself need no
trie; the others are handled from the deepest level up, and a level hands the
sums of its tries on to the nodes above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import numbered, small_side, stored, workers_see_package

#: Turns of a segment: bounds the paths, the skeleton (shards x SEGMENT nodes) and the groups.
SEGMENT = 128
#: Bytes of a turn's digest.
DIGEST = 16
#: Conversations in a row that take over turns of the first of them, and the most turns they take (exclusive).
FAMILY, MAX_TAKEN = 5, 9
#: Identifiers in a piece of text that is hashed later.
ENDS_PER_PIECE = 8192

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: finished node, partial of a skeleton node, ends of a skeleton node, sums of a finished trie below level 0.
FINISHED, PARTIAL, ENDS, TOP = range(4)
WALKED = (
    f"kind int, skeleton int, parent_skeleton int, shard int, piece int, p1 long, p2 long, {NODE},"
    " below_children long, below_leaves long, below_saved long, n_bytes long"
)
COLUMNS = [part.split()[0] for part in WALKED.split(",")]
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, position, digest, n_bytes) of rebuilt conversations, and (conv_id, n) of all of them.

    Turns are numbered by one global sort, so a conversation with a large part
    of all rows takes no single task; texts go no further than their digests.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST))
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = stored(numbered(narrow, order, "number").drop("turn"), "trie-turns")
    own = rows.groupBy("conv_id").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("own"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_TAKEN
    own = own.withColumn("take", taken).withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY)
    givers = own.where(F.col("conv_id") == F.col("donor")).select("donor", F.col("own").alias("offered"))
    lengths = own.join(givers, "donor", "left").withColumn(
        "head", F.least("take", F.coalesce("offered", F.lit(0).cast("long")))
    )
    lengths = stored(
        lengths.withColumn("n", F.col("head") + F.greatest(F.col("own") - F.col("take"), F.lit(0))), "trie-lengths"
    )
    placed = rows.join(lengths.select("conv_id", "first", "take", "head", "donor"), "conv_id").withColumn(
        "position", F.col("number") - F.col("first")
    )
    kept = placed.where(F.col("position") >= F.col("take")).select(
        "conv_id", (F.col("head") + F.col("position") - F.col("take")).alias("position"), "digest", "n_bytes"
    )
    offered = placed.where((F.col("conv_id") == F.col("donor")) & (F.col("position") < MAX_TAKEN - 1)).select(
        "donor", "position", "digest", "n_bytes"
    )
    given = (
        offered.join(lengths.select("conv_id", "donor", "head"), "donor")
        .where(F.col("position") < F.col("head"))
        .select("conv_id", "position", "digest", "n_bytes")
    )
    return kept.unionByName(given), lengths.select("conv_id", "n")


def segments(rebuilt: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """One row per segment: conv_id, level, path, sizes, last, the name (p1, p2) of what is before it, and (next1, next2)."""
    turn = F.struct("position", "digest", "n_bytes")
    cut = (
        rebuilt.withColumn("level", F.floor(F.col("position") / segment).cast("int"))
        .groupBy("conv_id", "level")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            "level",
            F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("path"),
            F.transform("turns", lambda x: x["n_bytes"]).alias("sizes"),
        )
    )
    empty = lengths.where("n = 0").select(
        "conv_id", F.lit(0).alias("level"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("sizes")
    )
    last_level = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / segment).cast("int")
    every = cut.unionByName(empty).join(lengths, "conv_id").withColumn("last", F.col("level") == last_level)
    lanes = [F.xxhash64("level", "path"), F.xxhash64("path", F.lit("second"), "level")]
    every = stored(every.withColumns({"lane1": lanes[0], "lane2": lanes[1]}), "trie-cut")
    # digests of all segments before: exclusive-or of numbered digests, a running sum over segments only
    before = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    short = every.where(F.col("n") <= segment).withColumns({"p1": none, "p2": none})
    long = every.where(F.col("n") > segment).withColumns(
        {f"p{k}": F.coalesce(F.bit_xor(f"lane{k}").over(before), none) for k in (1, 2)}
    )
    return short.unionByName(long).select(
        "conv_id", "level", "path", "sizes", "last", "p1", "p2",
        F.col("p1").bitwiseXOR(F.col("lane1")).alias("next1"), F.col("p2").bitwiseXOR(F.col("lane2")).alias("next2"),
    )


class Skeleton:
    """The trie of splitter paths: nodes by number, parents before children."""

    def __init__(self, splitters: list[tuple[int, int, bytes]]):
        self.tops: dict[tuple[int, int], int] = {}
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents: list[int] = []
        for p1, p2, path in splitters:
            node = self._at(self.tops, (p1, p2), -1)
            for i in range(0, len(path), DIGEST):
                node = self._at(self.children, (node, path[i : i + DIGEST]), node)

    def _at(self, nodes: dict, key: tuple, parent: int) -> int:
        if key not in nodes:
            nodes[key] = len(self.parents)
            self.parents.append(parent)
        return nodes[key]


class Node:
    """A node of the current path while its members go by."""

    __slots__ = ("below", "children", "conv", "ended", "ends", "leaves", "n", "n_bytes", "pending", "pieces", "saved", "skeleton")

    def __init__(self, n_bytes: int, skeleton: int | None):
        self.n_bytes, self.skeleton = n_bytes, skeleton
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.below, self.ends, self.ended, self.pieces = (0, 0, 0), [], None, 0
        self.pending = []  # finished children that wait for this node's smallest member


class Walk:
    """Nodes of one shard's sorted paths, finished as soon as their last member is past."""

    def __init__(self, shard: int, base: int, skeleton: Skeleton):
        self.shard, self.base, self.skeleton = shard, base, skeleton  # base: depth of the tops
        self.top, self.path, self.above, self.stack, self.rows = None, b"", None, [], []

    def row(self, kind: int, **values) -> None:
        self.rows.append(tuple({"kind": kind, "shard": self.shard, **values}.get(c) for c in COLUMNS))

    def add(self, top, path, sizes, conv, last, below, above) -> None:
        if top != self.top:
            self.close(0)
            self.top, self.path, self.above = top, b"", above
            self.stack = [Node(0, self.skeleton.tops.get(top))]
        common = 0
        if path == self.path:
            common = len(path)
        else:
            most = min(len(path), len(self.path))
            while common < most and path[common : common + DIGEST] == self.path[common : common + DIGEST]:
                common += DIGEST
        self.close(common // DIGEST + 1)
        for i in range(common, len(path), DIGEST):
            parent = self.stack[-1].skeleton
            own = None if parent is None else self.skeleton.children.get((parent, path[i : i + DIGEST]))
            self.stack.append(Node(sizes[i // DIGEST], own))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(conv, node.conv)
        if last:
            node.ends.append(str(conv))
            if len(node.ends) >= ENDS_PER_PIECE:
                self._hash(node)
        else:
            node.below = below

    def _hash(self, node: Node) -> None:
        text = ",".join(node.ends)
        if node.skeleton is not None:
            self.row(ENDS, skeleton=node.skeleton, piece=node.pieces, ends_sha256=text)
        else:
            if node.ended is None:
                node.ended = hashlib.sha256()
            node.ended.update(("," if node.pieces else "").encode() + text.encode())
        node.pieces += 1
        node.ends = []

    def close(self, depth: int) -> None:
        """Finish the nodes of the current path from its end up to ``depth``."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            at = len(self.stack)
            if node.ends:
                self._hash(node)
            if parent is not None:
                parent.n += node.n
                parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
            if node.skeleton is not None:
                self.row(
                    PARTIAL, skeleton=node.skeleton, depth=self.base + at, conv_id=node.conv, n_convs=node.n,
                    n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, n_bytes=node.n_bytes,
                    below_children=node.below[0], below_leaves=node.below[1], below_saved=node.below[2],
                    p1=self.top[0], p2=self.top[1], parent_conv_id=self.above,
                )
                continue
            children = node.children + node.below[0]
            leaves = node.leaves + node.below[1] if children else 1
            saved = (node.n - 1) * node.n_bytes + node.saved + node.below[2]
            for finished in node.pending:
                self.row(FINISHED, **finished, parent_conv_id=node.conv)
            if at == 0 and self.base:
                self.row(TOP, p1=self.top[0], p2=self.top[1], n_children=children, n_leaves=leaves, saved_tokens=saved)
                continue
            own = {
                "conv_id": node.conv, "depth": self.base + at, "n_convs": node.n, "n_children": children,
                "n_leaves": leaves, "saved_tokens": saved,
                "ends_sha256": node.ended.hexdigest() if node.ended else NOTHING,
            }
            if parent is None:
                self.row(FINISHED, **own)
                continue
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            if at == 1 and self.base:
                self.row(FINISHED, **own, parent_conv_id=self.above)
            elif parent.skeleton is not None:
                self.row(FINISHED, **own, parent_skeleton=parent.skeleton)
            else:
                parent.pending.append(own)

    def take(self) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([r[k] for r in self.rows], dtype=object) for k, c in enumerate(COLUMNS)})
        self.rows = []
        return out


def _walked(sorted_rows: DataFrame, base: int, splitters: list) -> DataFrame:
    """The rows of all shards' walks; a partition is a shard."""
    shared = sorted_rows.sparkSession.sparkContext.broadcast(Skeleton(splitters))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            for shard, p1, p2, path, conv, sizes, last, c, n, s, above in zip(
                batch["shard"], batch["p1"], batch["p2"], batch["path"], batch["conv_id"], batch["sizes"],
                batch["last"], batch["below_children"], batch["below_leaves"], batch["below_saved"], batch["above"],
            ):
                if now is None:
                    now = Walk(shard, base, shared.value)
                now.add((p1, p2), bytes(path), sizes, int(conv), last, (int(c), int(n), int(s)), int(above))
            if now is not None:
                yield now.take()
        if now is not None:
            now.close(0)
            yield now.take()

    return sorted_rows.mapInPandas(walk, WALKED)


def _ends(pieces: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): the pieces of each node's ends in order, hashed as they stream by."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            for own, text in zip(batch["skeleton"], batch["ends_sha256"]):
                if own != node:
                    if node is not None:
                        yield pd.DataFrame({"skeleton": [node], "ends_sha256": [running.hexdigest()]})
                    node, running = own, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
        if node is not None:
            yield pd.DataFrame({"skeleton": [node], "ends_sha256": [running.hexdigest()]})

    in_order = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece")
    return in_order.select("skeleton", "ends_sha256").mapInPandas(hashed, "skeleton int, ends_sha256 string")


def _reduced(walked: DataFrame, base: int, parents: list[int]) -> tuple[DataFrame, DataFrame]:
    """Skeleton nodes (with their number) and the sums of tries whose top is one, from the shards' partials.

    The skeleton has at most SEGMENT + 1 nodes for each shard, whatever the
    number of conversations, so its sums are folded by the driver, children
    before parents.
    """
    spark = walked.sparkSession
    sums = (
        walked.where(F.col("kind") == PARTIAL)
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.max(c).alias(c) for c in ("depth", "n_bytes", "below_children", "below_leaves", "below_saved", "p1", "p2")],
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("parent_conv_id").alias("above"),
        )
        .collect()
    )
    nodes = {r["skeleton"]: r.asDict() for r in sums}
    for i in sorted(nodes, reverse=True):
        node = nodes[i]
        node["n_children"] += node["below_children"]
        node["n_leaves"] = node["n_leaves"] + node["below_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["n_bytes"] + node["below_saved"]
        if parents[i] >= 0:
            above = nodes[parents[i]]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    own, tops = [], []
    for i, x in nodes.items():
        if parents[i] < 0 and base:
            tops.append((x["p1"], x["p2"], x["n_children"], x["n_leaves"], x["saved_tokens"]))
            continue
        parent = None
        if parents[i] >= 0:
            parent = x["above"] if base and parents[parents[i]] < 0 else nodes[parents[i]]["conv_id"]
        own.append((i, x["conv_id"], x["depth"], parent, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]))
    numbered_nodes = ", ".join(["skeleton int", *NODE.split(", ")[:-1]])
    skeleton = spark.createDataFrame(own, numbered_nodes).join(
        _ends(walked.where(F.col("kind") == ENDS)), "skeleton", "left"
    )
    return skeleton, spark.createDataFrame(tops, "p1 long, p2 long, n_children long, n_leaves long, saved_tokens long")


def _level(rows: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the tries whose tops are ``base`` deep, and the sums of these tries by (p1, p2)."""
    key = ["p1", "p2", "path", "conv_id"]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("shard", F.spark_partition_id())
    shards = stored(dealt, "trie-shards")
    borders = shards.groupBy("shard").agg(F.min(F.struct(*key)).alias("first")).orderBy("shard").collect()
    splitters = [(r["first"]["p1"], r["first"]["p2"], bytes(r["first"]["path"])) for r in borders[1:]]
    if not borders:
        return shards.sparkSession.createDataFrame([], NODE), shards.sparkSession.createDataFrame([], WALKED)
    in_place = shards.repartitionById(borders[-1]["shard"] + 1, "shard").sortWithinPartitions(*key)
    walked = stored(_walked(in_place, base, splitters), "trie-walked")
    skeleton, tops = _reduced(walked, base, Skeleton(splitters).parents)
    skeleton = stored(skeleton, "trie-skeleton")
    names = [part.split()[0] for part in NODE.split(",")]
    known = skeleton.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_parent"))
    finished = (
        walked.where(F.col("kind") == FINISHED)
        .join(small_side(known, 16), "parent_skeleton", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
        .select(*names)
    )
    own = skeleton.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*names)
    sums = walked.where(F.col("kind") == TOP).select(*tops.columns).unionByName(tops)
    return finished.unionByName(own), sums


def _alone(rows: DataFrame, segment: int) -> DataFrame:
    """Nodes of segments that one conversation has to itself: a chain."""
    n = F.size("sizes")
    chain = rows.withColumn("k", F.explode(F.sequence(F.lit(1), n))).withColumn("end", F.col("last") & (F.col("k") == n))
    one = F.lit(1).cast("long")
    return chain.select(
        "conv_id",
        (F.col("level") * segment + F.col("k")).cast("long").alias("depth"),
        F.when(F.col("k") == 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("end"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.
    Turns go by ``turn``, null first; those with equal numbers, and repeated
    rows, are turns of their own, in the order of their digests.  Null roles
    and texts are empty.  Rows without a conv_id belong to no conversation.
    A table without conversations gives no rows, not even a root.  Levels are
    handled one after the other; their number is the longest run of turns that
    two conversations share from the start, divided by ``segment``.
    """
    workers_see_package(turns.sparkSession)
    rebuilt, lengths = rebuilt_turns(turns)
    cut = stored(segments(rebuilt, lengths, segment), "trie-segments")
    none = F.lit(0).cast("long")
    nothing_below = {"below_children": none, "below_leaves": none, "below_saved": none}
    deep = cut.where("level > 0")
    parts, sums = [], None
    if deep.take(1):
        top = ["level", "p1", "p2"]
        full = cut.where(F.size("sizes") == segment)
        above = full.groupBy((F.col("level") + 1).alias("level"), F.col("next1").alias("p1"), F.col("next2").alias("p2")).agg(
            F.min("conv_id").alias("above")
        )
        members = deep.groupBy(*top).agg(F.count(F.lit(1)).alias("members")).join(above, top)
        deep = stored(deep.join(members, top), "trie-deep")
        single = deep.where("members = 1")
        parts.append(_alone(single, segment))
        shared = deep.where("members > 1")
        for level in range(shared.agg(F.max("level")).first()[0] or 0, 0, -1):
            rows = _with_below(shared.where(F.col("level") == level), single.where(F.col("level") == level + 1), sums)
            nodes, sums = _level(rows, level * segment)
            parts.append(nodes)
        rows = _with_below(cut.where("level = 0").withColumn("above", none), single.where("level = 1"), sums)
    else:
        rows = cut.withColumns({"above": none, **nothing_below})
    nodes, _ = _level(rows, 0)
    for part in parts:
        nodes = nodes.unionByName(part)
    return nodes


def _with_below(rows: DataFrame, single: DataFrame, sums: DataFrame | None) -> DataFrame:
    """``rows`` with the sums of the tries that go on where they end."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = single.select("p1", "p2", one.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
    known = chains if sums is None else chains.unionByName(sums.select(*chains.columns))
    known = known.select(
        F.col("p1").alias("next1"), F.col("p2").alias("next2"), F.col("n_children").alias("below_children"),
        F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"),
    )
    # a short segment goes on nowhere, whatever its digest
    inner, outer = rows.where("last"), rows.where("not last")
    names = ["below_children", "below_leaves", "below_saved"]
    return inner.withColumns({name: none for name in names}).unionByName(
        outer.join(known, ["next1", "next2"]), allowMissingColumns=True
    )
