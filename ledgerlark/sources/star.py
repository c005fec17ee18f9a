"""The sales star: one fact table and its two dimensions.

Columns the metric layer relies on:

``sales``     order_id, date, store_id, product_id, qty, amount_cents
``stores``    store_id, store_name, category, district
``products``  product_id, product_name, product_category, unit_price_cents
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.schemas import WAREHOUSE


@dataclass(frozen=True)
class SalesStar:
    """``keys_verified`` says that every fact is known to have its store and
    its product (published tables, or a checked foreign key).  Then a query
    joins only the dimensions whose columns it needs; otherwise facts without
    a partner are dropped first, as an inner join would.  ``measured`` keeps
    the bytes of the dimensions, and the first and last date, once they are known.
    ``rollups``, if there are any, answer what they can instead of the facts.
    """

    sales: DataFrame
    stores: DataFrame
    products: DataFrame
    keys_verified: bool = False
    measured: dict = field(default_factory=dict, compare=False)
    rollups: DataFrame | None = None

    def dates(self) -> tuple[date, date] | None:
        """The first and the last date of the facts; None if there are none."""
        if "dates" not in self.measured:
            first, last = self.sales.agg(F.min("date"), F.max("date")).first()
            self.measured["dates"] = None if first is None else (first, last)
        return self.measured["dates"]


def warehouse_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A warehouse table with its declared schema; no file is opened to infer it."""
    return spark.read.schema(WAREHOUSE[name]).parquet(f"{folder}/{name}.parquet")


def warehouse_star(spark: SparkSession, folder: str) -> SalesStar:
    """Order lines of the warehouse tables as sales, parts as products and
    suppliers as stores, whose category is the region and district the nation.

    The files' keys are verified once for each state of the files; if some fact
    has no partner, every query drops such facts.
    """
    from ledgerlark.sources.proof import proven

    lines = warehouse_table(spark, folder, "lineitem")
    sales = lines.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
    )
    nations = warehouse_table(spark, folder, "nation")
    regions = warehouse_table(spark, folder, "region")
    stores = (
        warehouse_table(spark, folder, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("r_name").alias("category"),
            F.col("n_name").alias("district"),
        )
    )
    products = warehouse_table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("unit_price_cents"),
    )
    tables = ("lineitem", "supplier", "nation", "region", "part")
    return proven(SalesStar(sales, stores, products), [f"{folder}/{name}.parquet" for name in tables])
