"""Helpers of the training-data operators: written tables, row identity, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.session import shared_folder, stored

__all__ = ["PLACE", "apart", "located", "new_names", "numbered", "shared_folder", "small_batches", "small_side", "stored", "table", "workers_see_package"]

ROOT = str(Path(__file__).resolve().parents[2])

#: The white space of the text contracts, as a character class body for Java and Python.
SPACE = r"\x20\x09-\x0D"

#: Low bits of monotonically_increasing_id(): the place of a row in its partition.
PLACE_BITS = 33


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers are started with the folder on their path.  On a cluster the
    package is installed, or added with ``addPyFile``; the path then does no harm.
    """
    known = spark.sparkContext.environment
    path = known.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        known["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose helper columns, which begin with an underscore, never meet the user's.

    Its first argument's columns of that form, and those whose names cannot
    stand in expressions as they are, get other names while it works, but for
    those named in its arguments, and their own names afterwards.
    """

    @wraps(operator)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        named = {*args, *kwargs.values()}
        clashing = [c for c in rows.columns if c not in named and (c.startswith("_") or not {*".`"}.isdisjoint(c))]
        hidden = {c: f"set aside {i}" for i, c in enumerate(clashing)}
        out = operator(rows.withColumnsRenamed(hidden), *args, **kwargs)
        return out.withColumnsRenamed({v: c for c, v in hidden.items() if v in out.columns})

    return run


#: Bytes of a batch of rows that goes to a Python worker, where texts can be long.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries run in here send at most about BATCH_BYTES to a Python worker at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: The place of a row: its file (hashed) and its number there.
PLACE = ["_row_file", "_row_place"]


def located(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns ``PLACE``; rows that have them stay as they are.

    Unlike numbers given by a scan, these stay the same however a later job
    splits the files, so several jobs can refer to the same row.  Rows that do
    not come straight from files are written to the shared folder first.
    """
    if set(PLACE) <= set(rows.columns):
        return rows
    where = [
        F.xxhash64("_metadata.file_path").alias(PLACE[0]),
        F.col("_metadata.row_index").alias(PLACE[1]),
    ]
    try:
        return rows.select("*", *where)
    except AnalysisException:
        return stored(rows, "located").select("*", *where)


def numbered(rows: DataFrame, order: list[str | Column], number: str, written: bool = False) -> DataFrame:
    """``rows`` with gapless numbers from 0, in the order of ``order``.

    One range shuffle; the rows are written first (unless they are ``written``),
    as the shuffle reads them twice, once for a sample, and again once sorted,
    so a number never changes when an executor is lost.  Rows equal in ``order`` are split between
    partitions by a last key, so a very frequent value takes no single task.
    Only one small row per partition is summed up and broadcast.
    """
    tie, at, part, count, start = new_names(rows, "tie", "place", "part", "rows", "start")
    placed = (
        (rows if written else stored(rows, "to-number"))
        .withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    kept = stored(placed, "numbered").withColumn(part, F.shiftright(at, PLACE_BITS))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy(part)
        .agg(F.count(F.lit(1)).alias(count))
        .select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    )
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        kept.join(F.broadcast(starts), part)
        .withColumn(number, F.col(start) + place)
        .drop(part, at, start)
    )


def new_names(rows: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``rows`` does not have, whatever a user's columns are called."""
    taken = {column.lower() for column in rows.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes that a broadcast table may have; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def small_side(rows: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``rows`` marked for broadcast if they are small, else as they are.

    ``row_bytes`` is what a row takes, or a column of it; the sum decides.
    """
    each = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = rows.agg(F.sum(each + 16)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows
