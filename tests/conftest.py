from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlark.session import local_session  # noqa: E402
from ledgerlark.sources.star import SalesStar  # noqa: E402

SALES = "order_id string, date date, store_id string, product_id string, qty bigint, amount_cents bigint"
STORES = "store_id string, store_name string, category string, district string"
PRODUCTS = "product_id string, product_name string, product_category string, unit_price_cents bigint"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def small_star(spark) -> SalesStar:
    """Two stores, two products, seven order lines in late summer."""
    lines = """
        A0 2025-08-20 N1 D2 1  400
        A1 2025-09-09 N2 D1 1 1200
        A2 2025-09-10 N1 D1 3 3600
        A2 2025-09-10 N1 D2 2  800
        A3 2025-09-11 N1 D2 1  400
        A4 2025-09-11 N2 D1 1 1200
        A5 2025-09-11 N2 D2 4 1600
    """
    sales = [
        (order, date.fromisoformat(day), store, product, int(qty), int(cents))
        for order, day, store, product, qty, cents in map(str.split, lines.strip().splitlines())
    ]
    stores = [("N1", "Quay Kitchen", "小吃", "江城北岸"), ("N2", "Hill Kitchen", "火锅", "江城南山")]
    products = [("D1", "酸辣粉", "热食", 1200), ("D2", "豆浆", "冷饮", 400)]
    return SalesStar(
        spark.createDataFrame(sales, SALES),
        spark.createDataFrame(stores, STORES),
        spark.createDataFrame(products, PRODUCTS),
        keys_verified=True,
    )


@pytest.fixture(scope="session")
def quality_run(spark):
    """The latest run as the ledger shows it."""
    from ledgerlark import schemas
    from pyspark.sql import functions as F

    summary = '{"raw_sales": 5208, "valid_sales": 5160, "quarantined_sales": 37}'
    return spark.createDataFrame([(7, "a" * 64, "test", summary)], "run_id long, source_hash string, rule_version string, text string").select(
        "run_id",
        "source_hash",
        "rule_version",
        F.lit("2025-10-02 06:30:00").cast("timestamp_ntz").alias("updated_at"),
        F.from_json("text", schemas.SUMMARY).alias("summary"),
    )
