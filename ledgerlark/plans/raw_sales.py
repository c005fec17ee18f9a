"""Raw point-of-sale rows derived from the event and part tables.

The statement runs unchanged in Spark and in DuckDB.  It yields every kind of
dirt the rules know: three date forms, currency signs, padded and lower-case
ids, blank and unreadable cells, unknown keys, exact copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.star import warehouse_table

RAW_SALES_SQL = """
WITH price AS (
  SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents FROM part
),
e AS (
  SELECT event_id AS e, CAST(ts AS DATE) AS d, (SELECT min(s_suppkey) FROM supplier) + user_id % (SELECT count(*) FROM supplier) AS sk,
         (SELECT min(p_partkey) FROM part) + (event_id * 7) % (SELECT count(*) FROM part) AS pk, event_type AS payment,
         CASE WHEN event_id % 401 = 0 THEN 0 WHEN event_id % 409 = 0 THEN -1 - event_id % 5 ELSE 1 + event_id % 5 END AS q
  FROM events
),
c AS (
  SELECT e.*, abs(q) * coalesce(unit_price_cents, 0) + CASE WHEN e % 433 = 0 OR (q = 0 AND e % 802 <> 0) THEN 100 ELSE 0 END AS cents
  FROM e LEFT JOIN price ON p_partkey = pk
),
f AS (
  SELECT e, 'O' || CAST(CAST(floor(e / 2) AS BIGINT) AS STRING) AS order_id,
    CASE WHEN e % 443 = 0 THEN '13/45/2024'
         WHEN e % 3 = 0 THEN lpad(CAST(year(d) AS STRING),4,'0') || '-' || lpad(CAST(month(d) AS STRING),2,'0') || '-' || lpad(CAST(day(d) AS STRING),2,'0')
         WHEN e % 3 = 1 THEN lpad(CAST(day(d) AS STRING),2,'0') || '-' || lpad(CAST(month(d) AS STRING),2,'0') || '-' || lpad(CAST(year(d) AS STRING),4,'0')
         ELSE lpad(CAST(year(d) AS STRING),4,'0') || '/' || lpad(CAST(month(d) AS STRING),2,'0') || '/' || lpad(CAST(day(d) AS STRING),2,'0') END AS date,
    CASE WHEN e % 211 = 0 OR e % 1010 = 0 THEN 'S999999' WHEN e % 13 = 0 THEN 's' || CAST(sk AS STRING) || ' ' ELSE 'S' || CAST(sk AS STRING) END AS store_id,
    CASE WHEN e % 307 = 0 THEN 'P999999' WHEN e % 17 = 0 THEN 'p' || CAST(pk AS STRING) ELSE 'P' || CAST(pk AS STRING) END AS product_id,
    CASE WHEN e % 419 = 0 THEN 'x' ELSE CAST(q AS STRING) END AS qty,
    CASE WHEN e % 101 = 0 THEN '' WHEN e % 439 = 0 THEN 'abc'
         ELSE CASE WHEN e % 97 = 0 THEN '¥' ELSE '' END || CASE WHEN e % 431 = 0 OR e % 818 = 0 THEN '-' ELSE '' END
              || CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING),2,'0') END AS amount,
    payment
  FROM c
)
SELECT 2 * e + 2 AS row_number, order_id, date, store_id, product_id, qty, amount, payment FROM f
UNION ALL
SELECT 2 * e + 3, order_id, date, store_id, product_id, qty, amount, payment FROM f WHERE e % 157 = 0
"""


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    names = ("part", "supplier", "events")
    text = RAW_SALES_SQL
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: warehouse_table(spark, folder, name) for name in names})


def raw_stores(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse_table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("store_id")
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse_table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("unit_price_cents"),
    )
