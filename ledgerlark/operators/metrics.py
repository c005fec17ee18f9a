"""The metric layer: revenue, distinct orders and average order value.

Counting distinct orders per group shuffles by (group, order), so a group
that holds a large part of all rows is spread over all tasks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.fixed import DIMENSIONS, MAX_TOP_LIMIT, METRICS, TOP_PRODUCT_COUNT
from ledgerlark.functions.periods import day
from ledgerlark.functions.rounding import (
    average_cents,
    direction,
    percent_change,
    share_percent,
)
from ledgerlark.operators.filters import (
    SalesFilter,
    check_range,
    require_known_store,
    selected_sales,
    star_side,
    with_dimensions,
)
from ledgerlark.operators.rollups import KEYS, orders_since, variant_name
from ledgerlark.sources.star import SalesStar

DIMENSION_COLUMNS = dict(
    zip(DIMENSIONS, ("category", "store_name", "product_name", "product_category"))
)


def revenue() -> Column:
    return F.sum("amount_cents").alias("revenue_cents")


def orders() -> Column:
    return F.countDistinct("order_id").alias("order_count")


def average_order_value(
    revenue_cents: str = "revenue_cents", order_count: str = "order_count"
) -> Column:
    return average_cents(F.col(revenue_cents), F.col(order_count))


def star_join(star: SalesStar, where: SalesFilter | None = None) -> DataFrame:
    """Every selected fact with all attributes of its product and its store."""
    columns = ("product_name", "product_category", "unit_price_cents")
    columns += ("store_name", "category", "district")
    if where is None:
        return with_dimensions(star, star.sales, columns)
    return selected_sales(star, where, columns)


def orphan_keys(star: SalesStar) -> DataFrame:
    """How many facts have no store, and how many no product."""
    stores = star.stores.select("store_id", F.lit(True).alias("has_store"))
    products = star.products.select("product_id", F.lit(True).alias("has_product"))
    return (
        star.sales.select("store_id", "product_id")
        .join(star_side(star, "store_id", stores), "store_id", "left")
        .join(star_side(star, "product_id", products), "product_id", "left")
        .agg(
            F.count("*").alias("sales"),
            F.count_if(F.col("has_store").isNull()).alias("without_store"),
            F.count_if(F.col("has_product").isNull()).alias("without_product"),
        )
    )


class _Selected:
    """Selected rows, grouped by some keys at most: steps of a published rollup where it has them, else facts.

    Rollups know stores and products, not names and categories.
    """

    def __init__(self, star: SalesStar, where: SalesFilter, by: tuple[str, ...] = (), in_range: Column | None = None):
        self.rolled = star.rollups is not None and not (where.product_name or where.store_category)
        if self.rolled:
            keys = tuple(key for key in KEYS if key in by or (key == "store_id" and where.normal_store_id() is not None))
            of_variant = star.rollups.where(F.col("variant") == variant_name(keys))
            self.rows = of_variant.where(where.on_sales(in_range))
        else:
            self.rows = selected_sales(star, where, in_range=in_range)

    def orders(self, start: Column) -> Column:
        return orders_since(start) if self.rolled else orders()

    def facts(self) -> Column:
        return F.coalesce(F.sum("facts"), F.lit(0)) if self.rolled else F.count("*")


def _dashboard(star: SalesStar, where: SalesFilter, *by: str) -> _Selected:
    """Selected rows of a dashboard, which refuses a store that does not exist."""
    require_known_store(star, where.store_id)
    return _Selected(star, where, by)


def totals(star: SalesStar, where: SalesFilter) -> DataFrame:
    """One row: revenue, distinct orders, average order value."""
    selected = _Selected(star, where)
    return (
        selected.rows
        .agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("revenue_cents"), selected.orders(day(where.start_date)))
        .withColumn("average_order_value_cents", average_order_value())
    )


def revenue_report(star: SalesStar, where: SalesFilter) -> DataFrame:
    """``totals`` with the parameters of the query."""
    return totals(star, where).select(
        "*",
        day(where.start_date).alias("start_date"),
        day(where.end_date).alias("end_date"),
        F.lit(where.product_name).cast("string").alias("product_name"),
        F.lit(where.store_id).cast("string").alias("store_id"),
        F.lit(where.store_category).cast("string").alias("store_category"),
    )


def _two_periods(
    star: SalesStar, where: SalesFilter, previous_start: date, previous_end: date
) -> DataFrame:
    """One row with the totals of two ranges, from one pass over the facts.

    Each fact is tagged with the range it is in (with both when they overlap).
    """
    check_range(previous_start, previous_end)
    in_current = F.col("date").between(day(where.start_date), day(where.end_date))
    in_previous = F.col("date").between(day(previous_start), day(previous_end))
    selected = _Selected(star, where, in_range=in_current | in_previous)
    if previous_end < where.start_date or where.end_date < previous_start:
        period = F.when(in_current, "current").otherwise("previous")
    else:
        period = F.explode(
            F.array_compact(F.array(F.when(in_current, "current"), F.when(in_previous, "previous")))
        )
    start = F.when(F.col("period") == "current", day(where.start_date)).otherwise(day(previous_start))
    per_period = selected.rows.withColumn("period", period).groupBy("period").agg(revenue(), selected.orders(start))

    def of(name: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == name, F.col(column))), F.lit(0))

    return (
        per_period.agg(
            of("current", "revenue_cents").alias("revenue_cents"),
            of("current", "order_count").alias("order_count"),
            of("previous", "revenue_cents").alias("previous_revenue_cents"),
            of("previous", "order_count").alias("previous_order_count"),
        )
        .withColumn("average_order_value_cents", average_order_value())
        .withColumn(
            "previous_average_order_value_cents",
            average_order_value("previous_revenue_cents", "previous_order_count"),
        )
    )


def dashboard_summary(star: SalesStar, where: SalesFilter) -> DataFrame:
    """Totals of the range and of the equally long range before it."""
    require_known_store(star, where.store_id)
    periods = _two_periods(star, where, *where.previous_period())

    def change(name: str) -> Column:
        return percent_change(F.col(name), F.col(f"previous_{name}"))

    return periods.select(
        "revenue_cents",
        "order_count",
        "average_order_value_cents",
        "previous_revenue_cents",
        "previous_order_count",
        "previous_average_order_value_cents",
        change("revenue_cents").alias("revenue_change_percent"),
        change("order_count").alias("order_change_percent"),
        change("average_order_value_cents").alias("average_order_value_change_percent"),
    )


def compare_periods(
    star: SalesStar,
    metric: str,
    where: SalesFilter,
    previous_start: date,
    previous_end: date,
) -> DataFrame:
    """One metric over two ranges of any length, which may overlap."""
    _check_metric(metric)
    value = {
        "revenue": "revenue_cents",
        "order_count": "order_count",
        "average_order_value": "average_order_value_cents",
    }[metric]
    now, before = F.col("current_value"), F.col("previous_value")
    return (
        _two_periods(star, where, previous_start, previous_end)
        .select(
            F.lit(metric).alias("metric"),
            F.col(value).alias("current_value"),
            F.col(f"previous_{value}").alias("previous_value"),
        )
        .withColumn("change_percent", percent_change(now, before))
        .withColumn("direction", direction(now, before))
    )


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric: {metric}")


def daily(star: SalesStar, where: SalesFilter) -> DataFrame:
    """One row per date with sales, in date order."""
    selected = _dashboard(star, where)
    return (
        selected.rows.groupBy("date")
        .agg(revenue(), selected.orders(F.col("date")))
        .withColumn("average_order_value_cents", average_order_value())
        .orderBy("date")
    )


def trend(
    star: SalesStar, metric: str, where: SalesFilter, granularity: str = "day"
) -> DataFrame:
    """One metric per date with sales, in date order."""
    if granularity != "day":
        raise ValueError(f"trends are daily, not by {granularity}")
    _check_metric(metric)
    selected = _Selected(star, where)
    rows, order_count = selected.rows.groupBy("date"), selected.orders(F.col("date"))
    if metric == "revenue":
        points = rows.agg(F.sum("amount_cents").alias("value"))
    elif metric == "order_count":
        points = rows.agg(order_count.alias("value"))
    else:
        points = rows.agg(revenue(), order_count).select(
            "date", average_order_value().alias("value")
        )
    return points.orderBy("date")


def top_products(
    star: SalesStar, where: SalesFilter, limit: int = TOP_PRODUCT_COUNT
) -> DataFrame:
    """Products by revenue, ties by id, with a 1-based rank.

    Facts are summed by product key alone; names are looked up for the few
    winners, so the product table is never shuffled.
    """
    selected = _dashboard(star, where, "product_id")
    order = (F.desc("revenue_cents"), F.asc("product_id"))
    winners = (
        selected.rows.groupBy("product_id")
        .agg(F.sum("qty").alias("quantity"), revenue(), selected.orders(day(where.start_date)))
        .orderBy(*order)
        .limit(limit)
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    )
    names = star.products.select("product_id", "product_name", "product_category")
    return (
        winners.join(names, "product_id")
        .select(
            "rank",
            "product_id",
            "product_name",
            "product_category",
            "quantity",
            "revenue_cents",
            "order_count",
        )
        .orderBy("rank")
    )


def store_comparison(star: SalesStar, where: SalesFilter) -> DataFrame:
    """All stores with sales by revenue, ties by id, with their share.

    Facts are summed by store key before the store names are joined.  The
    total is a scalar subquery over these sums, not another scan of the facts.
    """
    selected = _dashboard(star, where, "store_id")
    per_store = selected.rows.groupBy("store_id").agg(revenue(), selected.orders(day(where.start_date)))
    total = per_store.agg(F.sum("revenue_cents")).scalar()
    names = star.stores.select("store_id", "store_name", "category", "district")
    return (
        per_store.join(names, "store_id")
        .withColumn("total_cents", total)
        .select(
            "store_id",
            "store_name",
            "category",
            "district",
            "revenue_cents",
            "order_count",
            share_percent(F.col("revenue_cents"), F.col("total_cents")).alias("share_percent"),
        )
        .orderBy(F.desc("revenue_cents"), F.asc("store_id"))
    )


def coverage(star: SalesStar, where: SalesFilter, latest_run: DataFrame | None = None) -> DataFrame:
    """How many facts are selected and the dates they span.

    ``latest_run`` is a one-row frame of the run ledger; its id and time are
    added as scalar subqueries.
    """
    selected = _dashboard(star, where)
    result = selected.rows.agg(
        selected.facts().alias("valid_rows"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )
    if latest_run is not None:
        result = result.select(
            "*",
            latest_run.select("run_id").scalar().alias("ingestion_run_id"),
            latest_run.select("completed_at").scalar().alias("updated_at"),
        )
    return result


def top_entities(
    star: SalesStar,
    dimension: str,
    where: SalesFilter,
    limit: int = 10,
    metric: str = "revenue",
) -> DataFrame:
    """The names with the highest revenue in one dimension, ties by name.

    Stores and products are ranked by name: entities of one name are one.
    """
    if metric != "revenue":
        raise ValueError(f"rankings go by revenue, not by metric {metric}")
    if dimension not in DIMENSION_COLUMNS:
        raise ValueError(f"no ranking by dimension {dimension}")
    if not 1 <= limit <= MAX_TOP_LIMIT:
        raise ValueError(f"limit {limit} is outside 1 to {MAX_TOP_LIMIT}")
    column = DIMENSION_COLUMNS[dimension]
    return (
        selected_sales(star, where, columns=(column,))
        .groupBy(F.col(column).alias("name"))
        .agg(F.sum("amount_cents").alias("value_cents"), orders())
        .orderBy(F.desc("value_cents"), F.asc("name"))
        .limit(limit)
    )
