"""Facts about the data set itself: dates, option lists, presets, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.fixed import ALL_DATA_LABEL
from ledgerlark.functions.periods import month_label, months_between
from ledgerlark.sources.star import SalesStar


def date_bounds(star: SalesStar) -> DataFrame:
    return star.sales.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def store_options(star: SalesStar) -> DataFrame:
    return star.stores.select("store_id", "store_name", "category", "district").orderBy("store_id")


def product_options(star: SalesStar) -> DataFrame:
    return star.products.select("product_id", "product_name", "product_category").orderBy(
        "product_id"
    )


def calendar_presets(star: SalesStar) -> DataFrame:
    """The whole range and every calendar month the data touches.

    Months carry their year only when the data spans several years.
    """
    bounds = date_bounds(star).where(F.col("date_min").isNotNull())
    first = F.col("month")
    one_year = F.year("date_min") == F.year("date_max")
    whole = bounds.select(
        F.lit(ALL_DATA_LABEL).alias("label"),
        F.col("date_min").alias("start_date"),
        F.col("date_max").alias("end_date"),
    )
    months = bounds.select(
        "date_min",
        "date_max",
        F.explode(months_between(F.col("date_min"), F.col("date_max"))).alias("month"),
    ).select(
        F.when(one_year, month_label(first))
        .otherwise(F.concat(F.year(first), F.lit("年"), month_label(first)))
        .alias("label"),
        first.alias("start_date"),
        F.last_day(first).alias("end_date"),
    )
    return whole.unionByName(months)

