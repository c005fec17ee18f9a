"""Registered metric queries over the warehouse star, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.periods import previous_period
from ledgerlark.functions.rounding import average_cents, money_text, share_percent
from ledgerlark.operators import catalogue, metrics
from ledgerlark.operators.filters import SalesFilter
from ledgerlark.sources.star import SalesStar, warehouse_star

ALL = SalesFilter(date(1990, 1, 1), date(2010, 12, 31))
YEAR = SalesFilter(date(1997, 1, 1), date(1997, 12, 31))
QUARTER = SalesFilter(date(1998, 4, 1), date(1998, 6, 30))
NOTHING = SalesFilter(date(2050, 1, 1), date(2050, 12, 31))
BY_PRODUCT = SalesFilter(date(1996, 1, 1), date(1999, 12, 31), product_name="red plate ")
BY_STORE = SalesFilter(date(1996, 1, 1), date(1999, 12, 31), store_id=7)
BY_CATEGORY = SalesFilter(date(1996, 1, 1), date(1999, 12, 31), store_category="ASIA")

Query = Callable[[SparkSession, str], DataFrame]


def _on_star(build: Callable[[SalesStar], DataFrame]) -> Query:
    return lambda spark, folder: build(warehouse_star(spark, folder))


def _top_products_with_money(star: SalesStar) -> DataFrame:
    return metrics.top_products(star, YEAR).select(
        "product_id",
        "revenue_cents",
        money_text(F.col("revenue_cents")).alias("revenue_text"),
        money_text(-F.col("revenue_cents")).alias("refund_text"),
    )


def _previous_periods(star: SalesStar) -> DataFrame:
    """For each product: the equally long period before its sales period."""
    spans = star.sales.groupBy("product_id").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date")
    )
    before_start, before_end = previous_period(F.col("start_date"), F.col("end_date"))
    return spans.select(
        "*", before_start.alias("previous_start"), before_end.alias("previous_end")
    )


def _product_averages(star: SalesStar) -> DataFrame:
    """Average order value and refund share of every product."""
    total = star.sales.agg(F.sum("amount_cents")).scalar()
    per_product = (
        star.sales.groupBy("product_id")
        .agg(metrics.revenue(), metrics.orders())
        .withColumn("total_cents", total)
    )
    cents = F.col("revenue_cents")
    return per_product.select(
        "product_id",
        average_cents(cents, F.col("order_count")).alias("average_cents"),
        average_cents(-cents, F.col("order_count")).alias("average_refund_cents"),
        share_percent(cents, F.col("total_cents")).alias("share_percent"),
    )


QUERIES: dict[str, Query] = {
    "star_join": _on_star(metrics.star_join),
    "orphan_keys": _on_star(metrics.orphan_keys),
    "revenue_all": _on_star(lambda star: metrics.revenue_report(star, ALL)),
    "revenue_by_product_name": _on_star(lambda star: metrics.revenue_report(star, BY_PRODUCT)),
    "revenue_by_store": _on_star(lambda star: metrics.revenue_report(star, BY_STORE)),
    "revenue_by_store_category": _on_star(lambda star: metrics.revenue_report(star, BY_CATEGORY)),
    "revenue_empty": _on_star(lambda star: metrics.revenue_report(star, NOTHING)),
    "dashboard_summary": _on_star(lambda star: metrics.dashboard_summary(star, YEAR)),
    "dashboard_summary_store": _on_star(lambda star: metrics.dashboard_summary(star, BY_STORE)),
    "dashboard_daily": _on_star(lambda star: metrics.daily(star, YEAR)),
    "dashboard_top_products": _on_star(lambda star: metrics.top_products(star, YEAR)),
    "dashboard_store_comparison": _on_star(lambda star: metrics.store_comparison(star, YEAR)),
    "dashboard_coverage": _on_star(lambda star: metrics.coverage(star, YEAR)),
    "dashboard_coverage_empty": _on_star(lambda star: metrics.coverage(star, NOTHING)),
    "top_store_category": _on_star(lambda star: metrics.top_entities(star, "store_category", YEAR)),
    "top_store": _on_star(lambda star: metrics.top_entities(star, "store", YEAR)),
    "top_product": _on_star(lambda star: metrics.top_entities(star, "product", YEAR, 20)),
    "top_product_category": _on_star(
        lambda star: metrics.top_entities(star, "product_category", YEAR, 1)
    ),
    "compare_revenue": _on_star(
        lambda star: metrics.compare_periods(
            star, "revenue", QUARTER, date(1998, 1, 1), date(1998, 3, 31)
        )
    ),
    "compare_orders": _on_star(
        lambda star: metrics.compare_periods(
            star, "order_count", QUARTER, date(1998, 5, 1), date(1998, 7, 15)
        )
    ),
    "compare_aov": _on_star(
        lambda star: metrics.compare_periods(
            star, "average_order_value", BY_CATEGORY, date(1995, 1, 1), date(1995, 12, 31)
        )
    ),
    "compare_zero_baseline": _on_star(
        lambda star: metrics.compare_periods(
            star, "revenue", QUARTER, date(1980, 1, 1), date(1980, 3, 31)
        )
    ),
    "trend_revenue": _on_star(lambda star: metrics.trend(star, "revenue", YEAR)),
    "trend_orders": _on_star(lambda star: metrics.trend(star, "order_count", BY_PRODUCT)),
    "trend_aov": _on_star(lambda star: metrics.trend(star, "average_order_value", BY_CATEGORY)),
    "meta_date_range": _on_star(catalogue.date_bounds),
    "store_options": _on_star(catalogue.store_options),
    "product_options": _on_star(catalogue.product_options),
    "calendar_presets": _on_star(catalogue.calendar_presets),
    "money_format": _on_star(_top_products_with_money),
    "previous_period": _on_star(_previous_periods),
    "average_and_share": _on_star(_product_averages),
}

STAR_SQL = """
sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_shipdate AS DATE) AS date,
         l_suppkey AS store_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS qty,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents
  FROM lineitem
),
stores AS (
  SELECT s_suppkey AS store_id, s_name AS store_name, r_name AS category, n_name AS district
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
         CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents
  FROM part
)"""
_JOINED = "sales s JOIN products p USING (product_id) JOIN stores st USING (store_id)"
_SUMS = "CAST(sum(amount_cents) AS BIGINT) AS revenue_cents, count(DISTINCT order_id) AS order_count"


def _where(f: SalesFilter) -> str:
    parts = [f"date BETWEEN DATE '{f.start_date}' AND DATE '{f.end_date}'"]
    if f.store_id is not None:
        parts.append(f"store_id = {f.store_id}")
    if f.product_name:
        parts.append(f"product_name = '{f.product_name.strip()}'")
    if f.store_category:
        parts.append(f"category = '{f.store_category}'")
    return " AND ".join(parts)


def average_sql(revenue: str, orders: str) -> str:
    return (
        f"CASE WHEN {orders} <> 0 THEN CAST((CASE WHEN {revenue} < 0 THEN -1 ELSE 1 END)"
        f" * ((2 * abs(CAST({revenue} AS HUGEINT)) + {orders}) // (2 * {orders})) AS BIGINT) END"
    )


def change_sql(now: str, before: str) -> str:
    return (
        f"CASE WHEN {now} IS NOT NULL AND {before} <> 0 THEN"
        f" CAST((CASE WHEN ({now} < {before}) <> ({before} < 0) THEN -1 ELSE 1 END)"
        f" * ((2000 * abs(CAST({now} AS HUGEINT) - {before}) + abs({before}))"
        f" // (2 * abs({before}))) AS DOUBLE) / 10.0 END"
    )


def share_sql(part: str, total: str) -> str:
    return (
        f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST((CASE WHEN ({part} < 0) <> ({total} < 0) THEN -1 ELSE 1 END)"
        f" * ((2000 * abs(CAST({part} AS HUGEINT)) + abs({total})) // (2 * abs({total}))) AS DOUBLE) / 10.0 END"
    )


def _text(value: str | int | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _totals_sql(f: SalesFilter) -> str:
    return (
        "SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS revenue_cents,"
        f" count(DISTINCT order_id) AS order_count FROM {_JOINED} WHERE {_where(f)}"
    )


def _report_sql(f: SalesFilter) -> str:
    return f"""WITH {STAR_SQL}, t AS ({_totals_sql(f)})
SELECT revenue_cents, order_count, {average_sql("revenue_cents", "order_count")} AS average_order_value_cents,
       DATE '{f.start_date}' AS start_date, DATE '{f.end_date}' AS end_date,
       {_text(f.product_name)} AS product_name, {_text(f.store_id)} AS store_id,
       {_text(f.store_category)} AS store_category
FROM t"""


def _periods_sql(f: SalesFilter, start: date, end: date) -> str:
    return f"""WITH {STAR_SQL}, now AS ({_totals_sql(f)}), old AS ({_totals_sql(f.over(start, end))}),
both_periods AS (
  SELECT now.revenue_cents AS r, now.order_count AS o, old.revenue_cents AS pr, old.order_count AS po
  FROM now, old
),
v AS (SELECT *, {average_sql("r", "o")} AS a, {average_sql("pr", "po")} AS pa FROM both_periods)"""


def _summary_sql(f: SalesFilter) -> str:
    return f"""{_periods_sql(f, *f.previous_period())}
SELECT r AS revenue_cents, o AS order_count, a AS average_order_value_cents, pr AS previous_revenue_cents,
       po AS previous_order_count, pa AS previous_average_order_value_cents,
       {change_sql("r", "pr")} AS revenue_change_percent, {change_sql("o", "po")} AS order_change_percent,
       {change_sql("a", "pa")} AS average_order_value_change_percent
FROM v"""


def _compare_sql(metric: str, f: SalesFilter, start: date, end: date) -> str:
    now = {"revenue": "r", "order_count": "o", "average_order_value": "a"}[metric]
    old = f"p{now}"
    return f"""{_periods_sql(f, start, end)}
SELECT '{metric}' AS metric, {now} AS current_value, {old} AS previous_value,
       {change_sql(now, old)} AS change_percent,
       CASE WHEN {now} > {old} THEN 'up' WHEN {now} < {old} THEN 'down' ELSE 'flat' END AS direction
FROM v"""


def _trend_sql(metric: str, f: SalesFilter) -> str:
    value = {
        "revenue": "revenue_cents",
        "order_count": "order_count",
        "average_order_value": average_sql("revenue_cents", "order_count"),
    }[metric]
    return f"""WITH {STAR_SQL}, d AS (SELECT date, {_SUMS} FROM {_JOINED} WHERE {_where(f)} GROUP BY date)
SELECT date, {value} AS value FROM d"""


def _top_sql(column: str, f: SalesFilter, limit: int) -> str:
    return f"""WITH {STAR_SQL}
SELECT {column} AS name, CAST(sum(amount_cents) AS BIGINT) AS value_cents, count(DISTINCT order_id) AS order_count
FROM {_JOINED} WHERE {_where(f)} GROUP BY {column} ORDER BY value_cents DESC, name LIMIT {limit}"""


def _coverage_sql(f: SalesFilter) -> str:
    return f"""WITH {STAR_SQL}
SELECT count(*) AS valid_rows, min(date) AS date_min, max(date) AS date_max FROM {_JOINED} WHERE {_where(f)}"""


_TOP_PRODUCTS = f"""{STAR_SQL},
ranked AS (
  SELECT product_id, product_name, product_category, CAST(sum(qty) AS BIGINT) AS quantity, {_SUMS}
  FROM {_JOINED} WHERE {_where(YEAR)} GROUP BY product_id, product_name, product_category
  ORDER BY revenue_cents DESC, product_id LIMIT 10
)"""


def money_sql(cents: str) -> str:
    whole = f"abs({cents}) // 100"
    return (
        f"'¥' || CASE WHEN {cents} < 0 THEN '-' ELSE '' END || format('{{:,}}', {whole})"
        f" || '.' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0')"
    )


_MONTH_NAMES = "['一月', '二月', '三月', '四月', '五月', '六月', '七月', '八月', '九月', '十月', '十一月', '十二月']"

ORACLES: dict[str, str] = {
    "star_join": f"""WITH {STAR_SQL}
SELECT order_id, date, store_id, product_id, qty, amount_cents, product_name, product_category,
       unit_price_cents, store_name, category, district FROM {_JOINED}""",
    "orphan_keys": f"""WITH {STAR_SQL}
SELECT count(*) AS sales, count(*) FILTER (st.store_id IS NULL) AS without_store,
       count(*) FILTER (p.product_id IS NULL) AS without_product
FROM sales s LEFT JOIN stores st ON st.store_id = s.store_id LEFT JOIN products p ON p.product_id = s.product_id""",
    "revenue_all": _report_sql(ALL),
    "revenue_by_product_name": _report_sql(BY_PRODUCT),
    "revenue_by_store": _report_sql(BY_STORE),
    "revenue_by_store_category": _report_sql(BY_CATEGORY),
    "revenue_empty": _report_sql(NOTHING),
    "dashboard_summary": _summary_sql(YEAR),
    "dashboard_summary_store": _summary_sql(BY_STORE),
    "dashboard_daily": f"""WITH {STAR_SQL}, d AS (SELECT date, {_SUMS} FROM {_JOINED} WHERE {_where(YEAR)} GROUP BY date)
SELECT *, {average_sql("revenue_cents", "order_count")} AS average_order_value_cents FROM d""",
    "dashboard_top_products": f"""WITH {_TOP_PRODUCTS}
SELECT CAST(row_number() OVER (ORDER BY revenue_cents DESC, product_id) AS INT) AS rank, * FROM ranked""",
    "dashboard_store_comparison": f"""WITH {STAR_SQL},
per_store AS (
  SELECT store_id, store_name, category, district, {_SUMS}
  FROM {_JOINED} WHERE {_where(YEAR)} GROUP BY store_id, store_name, category, district
),
t AS (SELECT CAST(sum(revenue_cents) AS BIGINT) AS total FROM per_store)
SELECT per_store.*, {share_sql("revenue_cents", "total")} AS share_percent FROM per_store, t""",
    "dashboard_coverage": _coverage_sql(YEAR),
    "dashboard_coverage_empty": _coverage_sql(NOTHING),
    "top_store_category": _top_sql("category", YEAR, 10),
    "top_store": _top_sql("store_name", YEAR, 10),
    "top_product": _top_sql("product_name", YEAR, 20),
    "top_product_category": _top_sql("product_category", YEAR, 1),
    "compare_revenue": _compare_sql("revenue", QUARTER, date(1998, 1, 1), date(1998, 3, 31)),
    "compare_orders": _compare_sql("order_count", QUARTER, date(1998, 5, 1), date(1998, 7, 15)),
    "compare_aov": _compare_sql(
        "average_order_value", BY_CATEGORY, date(1995, 1, 1), date(1995, 12, 31)
    ),
    "compare_zero_baseline": _compare_sql("revenue", QUARTER, date(1980, 1, 1), date(1980, 3, 31)),
    "trend_revenue": _trend_sql("revenue", YEAR),
    "trend_orders": _trend_sql("order_count", BY_PRODUCT),
    "trend_aov": _trend_sql("average_order_value", BY_CATEGORY),
    "meta_date_range": f"WITH {STAR_SQL} SELECT min(date) AS date_min, max(date) AS date_max FROM sales",
    "store_options": f"WITH {STAR_SQL} SELECT store_id, store_name, category, district FROM stores",
    "product_options": f"WITH {STAR_SQL} SELECT product_id, product_name, product_category FROM products",
    "calendar_presets": f"""WITH {STAR_SQL},
b AS (SELECT min(date) AS lo, max(date) AS hi FROM sales),
m AS (
  SELECT lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS first
  FROM b
)
SELECT '全部数据' AS label, lo AS start_date, hi AS end_date FROM b
UNION ALL
SELECT CASE WHEN year(lo) = year(hi) THEN '' ELSE CAST(year(first) AS VARCHAR) || '年' END
       || {_MONTH_NAMES}[month(first)], CAST(first AS DATE), CAST(last_day(first) AS DATE) FROM m""",
    "money_format": f"""WITH {_TOP_PRODUCTS}
SELECT product_id, revenue_cents, {money_sql("revenue_cents")} AS revenue_text,
       {money_sql("(-revenue_cents)")} AS refund_text FROM ranked""",
    "previous_period": f"""WITH {STAR_SQL},
spans AS (SELECT product_id, min(date) AS start_date, max(date) AS end_date FROM sales GROUP BY product_id)
SELECT *, CAST(start_date - CAST(end_date - start_date + 1 AS INT) AS DATE) AS previous_start,
       CAST(start_date - 1 AS DATE) AS previous_end FROM spans""",
    "average_and_share": f"""WITH {STAR_SQL},
g AS (SELECT product_id, {_SUMS} FROM sales GROUP BY product_id),
t AS (SELECT CAST(sum(revenue_cents) AS BIGINT) AS total FROM g)
SELECT product_id, {average_sql("revenue_cents", "order_count")} AS average_cents,
       {average_sql("(-revenue_cents)", "order_count")} AS average_refund_cents,
       {share_sql("revenue_cents", "total")} AS share_percent
FROM g, t""",
}
