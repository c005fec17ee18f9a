"""Exact duplicates by a stateful stream whose keyed state never expires.

Documents arrive as a stream of digests.  The state, on the executors' disks
(RocksDB) with its versions in the shared folder, holds for each digest the
identifier and the place (content locator) of the row that stays, and the
number of rows.  Every hit, a row whose digest the state knows from another
row, is then checked: the full normalised texts of both rows are read by their
places and compared.  Texts that only share a digest form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, apart, located, shared_folder, small_side, stored

#: State on disk, without files set aside before they are needed: with many partitions of
#: little state these would take far more room than the state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Files of the digest log that one micro-batch takes at most.
FILES_PER_BATCH = 1000


def normalised(text: str) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rank() -> Column:
    """Smallest for the row that stays: most code points, then doc_id (null last), then place."""
    return F.struct(
        (-F.col("length")).alias("shorter"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        *[F.col(name) for name in PLACE],
    )


def keyed_state(spark: SparkSession, log: str, schema) -> DataFrame:
    """(digest, keep, group_size) after the stream over the folder ``log`` has seen all its rows."""
    checkpoint = shared_folder(spark, "dedup-state")
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(log)
        counted = arrivals.groupBy("digest").agg(
            F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("group_size")
        )
        stream = (
            counted.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    held = spark.read.format("statestore").load(checkpoint)
    keep, rows = held.schema["value"].dataType.names
    return held.select(
        "key.digest", F.col("value")[keep].alias("keep"), F.col("value")[rows].alias("group_size")
    )


def groups_of_equals(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: its place, doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical without white space; null counts as empty,
    so null, empty and blank texts are one group.  Of a group the row with the
    most code points stays, then the smallest doc_id (null last), then the
    first place in the files: of repeated rows exactly one is kept.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = located(docs).select(
        F.col(id_col).alias("doc_id"),
        *PLACE,
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("length"),
        normalised(text_col).alias("content"),
    )
    log = shared_folder(spark, "dedup-log")
    digests = rows.withColumn("digest", digest(F.col("content"))).drop("content")
    digests.write.parquet(log)
    seen = spark.read.schema(digests.schema).parquet(log)
    if not seen.take(1):  # a stream over no rows leaves no state to read
        return _result(seen.withColumn("keep", _rank()).withColumn("group_size", F.lit(1).cast("long")))
    state = stored(keyed_state(spark, log, digests.schema), "dedup-groups")

    several = small_side(state.where("group_size > 1").select("digest", "keep"), 100)
    alone = seen.join(several, "digest", "left_anti")

    hits = rows.withColumn("digest", digest(F.col("content"))).join(several, "digest")
    first = hits.where(
        (F.col("keep._row_file") == F.col("_row_file")) & (F.col("keep._row_place") == F.col("_row_place"))
    ).select("digest", F.col("content").alias("kept_content"))
    checked = stored(
        hits.drop("keep")
        .join(first, "digest")
        .withColumn("other", F.when(F.col("content") != F.col("kept_content"), F.col("content")))
        .drop("content", "kept_content"),
        "dedup-checked",
    )
    groups = (
        checked.groupBy("digest", "other")
        .agg(F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .withColumnsRenamed({"digest": "digest_of", "other": "other_of"})
    )
    same = (F.col("digest") == F.col("digest_of")) & F.col("other").eqNullSafe(F.col("other_of"))
    grouped = checked.join(groups, same).select(*seen.columns, "keep", "group_size")
    single = alone.withColumn("keep", _rank()).withColumn("group_size", F.lit(1).cast("long"))
    return _result(grouped.unionByName(single))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        *PLACE,
        "doc_id",
        "digest",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (
            (F.col("keep._row_file") == F.col("_row_file"))
            & (F.col("keep._row_place") == F.col("_row_place"))
        ).alias("kept"),
    )


@apart
def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    return groups_of_equals(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@apart
def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    rows = located(docs)
    gone = stored(groups_of_equals(rows).where(~F.col("kept")).select(*PLACE), "dedup-gone")
    return rows.join(small_side(gone, 16), PLACE, "left_anti").drop(*PLACE)
