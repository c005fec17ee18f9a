"""Rollups of published facts that answer dashboards with exact distinct orders.

Put the days an order sold on in order: its step from one to the next is
counted, with its revenue, quantity and facts, by both days.  An order of a
range has exactly one step in it whose earlier day is before the range (or
none), so any range is a sum over steps, whose number the calendar bounds.  The
steps are kept for all facts, by store, by product, and by both.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("store_id", "product_id")
VARIANTS = tuple(keys for n in range(len(KEYS) + 1) for keys in combinations(KEYS, n))
_SUMS = ("amount_cents", "qty", "facts")


def variant_name(keys: tuple[str, ...]) -> str:
    return ",".join(keys) or "all"


def by_order(facts: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Equal lines of an order summed, and an order's lines together.

    What repeats these rows for several keys needs no further shuffle for
    windows over (keys, order_id).  Lines fold first, so a frequent order has
    a row for each day and combination of its other columns at most.
    """
    others = [name for name in facts.columns if name not in sums]
    return facts.groupBy(*others).agg(*(F.sum(name).alias(name) for name in sums)).repartition("order_id")


def rollups(sales: DataFrame) -> DataFrame:
    """variant, store_id, product_id (null where not a key), previous_date, date, sums and orders.

    One pass: a fact is repeated for each variant.  Lines of a day fold first,
    so a frequent order has a row for each day and key.
    """
    groups = F.array(
        *(
            F.struct(
                F.lit(variant_name(keys)).alias("variant"),
                *(F.when(F.lit(key in keys), F.col(key)).alias(key) for key in KEYS),
            )
            for keys in VARIANTS
        )
    )
    group = ["variant", *KEYS]
    in_order = Window.partitionBy(*group, "order_id").orderBy("date")
    return (
        sales.withColumn("facts", F.lit(1).cast("long"))
        .select("order_id", "date", *_SUMS, F.explode(groups).alias("of"))
        .select("of.*", "order_id", "date", *_SUMS)
        .groupBy(*group, "order_id", "date")
        .agg(*(F.sum(name).alias(name) for name in _SUMS))
        .withColumn("previous_date", F.lag("date").over(in_order))
        .groupBy(*group, "previous_date", "date")
        .agg(*(F.sum(name).alias(name) for name in _SUMS), F.count("*").alias("orders"))
    )


def orders_since(start: Column) -> Column:
    """Distinct orders of steps in a range that begins at ``start``."""
    new = F.col("previous_date").isNull() | (F.col("previous_date") < start)
    return F.coalesce(F.sum(F.when(new, F.col("orders"))), F.lit(0)).alias("order_count")
