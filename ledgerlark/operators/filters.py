"""Filters of a metric query and the fact rows they select."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.fixed import WHITESPACE
from ledgerlark.functions.periods import day
from ledgerlark.sources.star import SalesStar

# A dimension of at most this many bytes is sent to every executor.
BROADCAST_BYTES = 64 << 20

STORE_COLUMNS = ("store_name", "category", "district")
PRODUCT_COLUMNS = ("product_name", "product_category", "unit_price_cents")


def check_range(start: date, end: date) -> None:
    if start > end:
        raise ValueError("start_date must not be after end_date")


@dataclass(frozen=True)
class SalesFilter:
    """An inclusive date range and up to three equality filters."""

    start_date: date
    end_date: date
    store_id: str | int | None = None
    product_name: str | None = None
    store_category: str | None = None

    def __post_init__(self) -> None:
        check_range(self.start_date, self.end_date)

    def over(self, start: date, end: date) -> SalesFilter:
        """The same filters over another range."""
        return SalesFilter(start, end, self.store_id, self.product_name, self.store_category)

    def previous_period(self) -> tuple[date, date]:
        days = (self.end_date - self.start_date).days + 1
        return self.start_date - timedelta(days=days), self.start_date - timedelta(days=1)

    def normal_store_id(self) -> str | int | None:
        if isinstance(self.store_id, str):
            return self.store_id.strip(WHITESPACE).upper() if self.store_id else None
        return self.store_id

    def on_sales(self, in_range: Column | None = None) -> Column:
        parts = [
            in_range
            if in_range is not None
            else F.col("date").between(day(self.start_date), day(self.end_date))
        ]
        store_id = self.normal_store_id()
        if store_id is not None:
            parts.append(F.col("store_id") == F.lit(store_id))
        return reduce(and_, parts)


def dimension_filter(column: str, value: str | None) -> Column | None:
    return F.col(column) == F.lit(value.strip(WHITESPACE)) if value else None


def _row_bytes(rows: DataFrame) -> Column:
    texts = [name for name, kind in rows.dtypes if kind == "string"]
    fixed = 16 * (1 + len(rows.columns) - len(texts))
    each = reduce(add, (F.coalesce(F.octet_length(name), F.lit(0)) + 8 for name in texts), F.lit(fixed))
    return F.sum(each.cast("bigint"))


def bytes_of(rows: DataFrame) -> int:
    """About how many bytes the rows take: their texts, and 16 for each other cell and row."""
    return rows.agg(_row_bytes(rows)).first()[0] or 0


def small_parts(rows: DataFrame, column: str, values: Sequence[str]) -> dict[str, DataFrame]:
    """The rows of each value of ``column``, marked for broadcast if small; all are measured at once."""
    sizes = dict(tuple(row) for row in rows.where(F.col(column).isin(*values)).groupBy(column).agg(_row_bytes(rows)).collect())
    parts = {value: rows.where(F.col(column) == value) for value in values}
    return {value: F.broadcast(part) if sizes.get(value, 0) <= BROADCAST_BYTES else part for value, part in parts.items()}


def broadcast_if_small(dimension: DataFrame) -> DataFrame:
    """Marked for broadcast if its bytes allow it; else a shuffle join, whose hot keys Spark splits."""
    return F.broadcast(dimension) if bytes_of(dimension) <= BROADCAST_BYTES else dimension


def star_side(star: SalesStar, key: str, part: DataFrame) -> DataFrame:
    """``part`` (columns or rows of a dimension), marked for broadcast if small.

    The whole dimension is measured once for a star; a part of a small one is small.
    """
    if key not in star.measured:
        star.measured[key] = bytes_of(star.products if key == "product_id" else star.stores)
    return F.broadcast(part) if star.measured[key] <= BROADCAST_BYTES else broadcast_if_small(part)


def with_dimensions(
    star: SalesStar,
    sales: DataFrame,
    columns: Sequence[str] = (),
    store_filter: Column | None = None,
    product_filter: Column | None = None,
) -> DataFrame:
    """Join the dimension ``columns`` to fact rows.

    A dimension is measured before it is broadcast, because Spark's estimate
    for a joined or filtered dimension is far too high and would shuffle all
    facts.  A larger one is left to Spark: a shuffle join whose skewed keys
    are split at run time.  A dimension without a wanted column is not joined
    at all when the keys are verified.
    """
    for key, dimension, offered, chosen in (
        ("product_id", star.products, PRODUCT_COLUMNS, product_filter),
        ("store_id", star.stores, STORE_COLUMNS, store_filter),
    ):
        wanted = [name for name in columns if name in offered]
        if chosen is not None:
            dimension = dimension.where(chosen)
        if wanted:
            sales = sales.join(star_side(star, key, dimension.select(key, *wanted)), key)
        elif chosen is not None or not star.keys_verified:
            sales = sales.join(star_side(star, key, dimension.select(key)), key, "left_semi")
    return sales


def selected_sales(
    star: SalesStar,
    where: SalesFilter,
    columns: Sequence[str] = (),
    in_range: Column | None = None,
) -> DataFrame:
    """Fact rows that pass ``where``, with the wanted dimension columns."""
    return with_dimensions(
        star,
        star.sales.where(where.on_sales(in_range)),
        columns,
        store_filter=dimension_filter("category", where.store_category),
        product_filter=dimension_filter("product_name", where.product_name),
    )


def require_known_store(star: SalesStar, store_id: str | int | None) -> str | int | None:
    """The normalised id, or an error when no store has it; blank is no filter."""
    if isinstance(store_id, str):
        store_id = store_id.strip(WHITESPACE).upper() or None
    if store_id is not None and star.stores.where(F.col("store_id") == F.lit(store_id)).isEmpty():
        raise ValueError(f"unknown store_id: {store_id}")
    return store_id
