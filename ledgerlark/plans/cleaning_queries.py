"""Registered cleaning queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import cleaning, quality
from ledgerlark.plans.ingest import content_digest
from ledgerlark.plans.raw_sales import RAW_SALES_SQL, raw_products, raw_sales, raw_stores


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.checked(
        raw_sales(spark, folder), raw_stores(spark, folder), raw_products(spark, folder)
    )


def _reason_text() -> F.Column:
    return F.array_join("reasons", ",").alias("reasons")


def clean_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.normalized(raw_sales(spark, folder)).select(
        "row_number",
        F.col("clean_order_id").alias("order_id"),
        F.col("clean_date").alias("date"),
        F.col("clean_store_id").alias("store_id"),
        F.col("clean_product_id").alias("product_id"),
        F.col("clean_qty").alias("qty"),
        F.col("reported_cents").alias("amount_cents"),
        F.col("clean_payment").alias("payment"),
    )


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_exact_duplicates(raw_sales(spark, folder))


def key_lookups(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.with_key_lookups(
        cleaning.normalized(raw_sales(spark, folder)),
        raw_stores(spark, folder),
        raw_products(spark, folder),
    )
    return rows.select(
        "row_number",
        F.col("store_known").isNotNull().cast("int").alias("store_known"),
        F.col("product_known").isNotNull().cast("int").alias("product_known"),
        "unit_price_cents",
    )


def checked_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select(
        "row_number",
        "copies_removed",
        "amount_cents",
        "amount_source",
        F.col("is_imputed").cast("int").alias("is_imputed"),
        _reason_text(),
    )


def dimension_key_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Product names and types that several parts share."""
    products = raw_products(spark, folder)
    names = ("product_name", "product_category")
    return reduce(
        DataFrame.unionByName,
        (
            cleaning.repeated_keys(products, name).select(
                F.lit(name).alias("key"), F.col(name).alias("value"), "copies"
            )
            for name in names
        ),
    )


def source_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of the products, as an ingestion run takes it."""
    return spark.range(1).select(content_digest(raw_products(spark, folder)).alias("fingerprint"))


def valid_sales(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.valid_sales(_checked(spark, folder))


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.quarantined_sales(_checked(spark, folder)).select(
        "row_number", "raw_json", _reason_text()
    )


def reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.reason_counts(_checked(spark, folder))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ingestion_summary(cleaning.outcomes(_checked(spark, folder)))


def ingestion_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder).select(
        *quality.COUNTS, "date_min", "date_max", F.to_json("issue_counts").alias("issue_counts")
    )


def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_score(_summary(spark, folder))


def conservation_check(spark: SparkSession, folder: str) -> DataFrame:
    return quality.conservation_check(_summary(spark, folder)).withColumn(
        "holds", F.col("holds").cast("int")
    )


QUERIES = {
    query.__name__: query
    for query in (
        clean_normalize,
        dedupe_first,
        dimension_key_repeats,
        source_fingerprint,
        key_lookups,
        checked_sales,
        valid_sales,
        quarantine,
        reason_counts,
        ingestion_summary,
        quality_score,
        conservation_check,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NORMAL_SQL = f"""
raw AS ({RAW_SALES_SQL}),
stores AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier),
products AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS product_id,
         CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents
  FROM part
),
trimmed AS (
  SELECT row_number, trim(order_id, {_BLANKS}) AS o, trim(date, {_BLANKS}) AS d,
         upper(trim(store_id, {_BLANKS})) AS s, upper(trim(product_id, {_BLANKS})) AS p,
         trim(qty, {_BLANKS}) AS q, trim(amount, {_BLANKS}) AS a,
         trim(payment, {_BLANKS}) AS pay
  FROM raw
),
normal AS (
  SELECT row_number, o AS order_id,
         CAST(try_strptime(d, ['%Y-%m-%d', '%d-%m-%Y', '%Y/%m/%d']) AS DATE) AS date,
         s AS store_id, p AS product_id,
         CASE WHEN regexp_full_match(q, '[+-]?[0-9]+') THEN TRY_CAST(q AS BIGINT) END AS qty,
         a = '' AS blank,
         CASE WHEN regexp_full_match(ltrim(regexp_replace(a, '^¥', '')), '[+-]?[0-9]+([.][0-9]*)?')
              THEN CAST(round(CAST(ltrim(regexp_replace(a, '^¥', '')) AS DECIMAL(38, 10)), 2) * 100 AS BIGINT)
         END AS reported,
         pay AS payment
  FROM trimmed
)"""
CHECKED_SQL = f"""{NORMAL_SQL},
firsts AS (
  SELECT order_id AS r1, date AS r2, store_id AS r3, product_id AS r4, qty AS r5, amount AS r6,
         payment AS r7, min(row_number) AS row_number, count(*) - 1 AS copies_removed
  FROM raw GROUP BY 1, 2, 3, 4, 5, 6, 7
),
looked AS (
  SELECT n.*, copies_removed, r1, r2, r3, r4, r5, r6, r7, st.store_id IS NOT NULL AS store_known,
         pr.product_id IS NOT NULL AS product_known, qty * unit_price_cents AS expected
  FROM firsts JOIN normal n USING (row_number)
  LEFT JOIN stores st ON st.store_id = n.store_id
  LEFT JOIN products pr ON pr.product_id = n.product_id
),
amounts AS (
  SELECT *, coalesce(blank AND qty > 0 AND product_known, FALSE) AS imputed,
         CASE WHEN blank AND qty > 0 AND product_known THEN expected WHEN NOT blank THEN reported END AS cents
  FROM looked
),
reasoned AS (
  SELECT *, concat_ws(',',
    CASE WHEN NOT blank AND reported IS NULL THEN 'invalid_amount' END,
    CASE WHEN date IS NULL THEN 'invalid_date' END,
    CASE WHEN qty IS NULL THEN 'invalid_quantity' END,
    CASE WHEN blank AND NOT imputed THEN 'missing_amount' END,
    CASE WHEN qty < 0 AND cents > 0 OR qty > 0 AND cents < 0 THEN 'quantity_amount_sign_conflict' END,
    CASE WHEN NOT product_known THEN 'unknown_product' END,
    CASE WHEN NOT store_known THEN 'unknown_store' END,
    CASE WHEN qty = 0 AND cents <> 0 THEN 'zero_quantity_nonzero_amount' END,
    CASE WHEN qty = 0 AND cents = 0 THEN 'zero_value_transaction' END) AS other
  FROM amounts
),
checked AS (
  SELECT *, CASE WHEN other = '' AND cents <> expected THEN 'amount_unit_price_mismatch' ELSE other END AS reasons
  FROM reasoned
),
occurrences AS (
  SELECT unnest(string_split(reasons, ',')) AS reason FROM checked WHERE reasons <> ''
),
counted AS (SELECT reason, count(*) AS occurrences FROM occurrences GROUP BY reason),
summary AS (
  SELECT CAST(sum(copies_removed + 1) AS BIGINT) AS raw_sales,
         CAST(sum(copies_removed) AS BIGINT) AS duplicate_rows_removed,
         count(*) FILTER (imputed) AS amounts_imputed,
         count(*) FILTER (reasons = '') AS valid_sales,
         count(*) FILTER (reasons <> '') AS quarantined_sales,
         min(date) FILTER (reasons = '') AS date_min, max(date) FILTER (reasons = '') AS date_max
  FROM checked
)"""

_LANES = ", ".join(
    f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * lane}, 15) AS HUGEINT)) AS VARCHAR)" for lane in range(4)
)

ORACLES = {
    "dimension_key_repeats": """WITH p AS (SELECT p_name AS product_name, p_type AS product_category FROM part)
SELECT 'product_name' AS key, product_name AS value, count(*) AS copies FROM p GROUP BY 2 HAVING count(*) > 1
UNION ALL
SELECT 'product_category', product_category, count(*) FROM p GROUP BY 2 HAVING count(*) > 1""",
    "source_fingerprint": f"""WITH hashed AS (
  SELECT sha256('{{"product_category":"' || p_type || '","product_id":"P' || p_partkey || '","product_name":"' || p_name
    || '","unit_price_cents":' || CAST(round(p_retailprice * 100) AS BIGINT) || '}}') AS h FROM part
)
SELECT sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_LANES})) AS fingerprint FROM hashed""",
    "clean_normalize": f"""WITH {NORMAL_SQL}
SELECT row_number, order_id, date, store_id, product_id, qty, reported AS amount_cents, payment FROM normal""",
    "dedupe_first": f"""WITH raw AS ({RAW_SALES_SQL})
SELECT order_id, date, store_id, product_id, qty, amount, payment, min(row_number) AS row_number,
       count(*) - 1 AS copies_removed
FROM raw GROUP BY order_id, date, store_id, product_id, qty, amount, payment""",
    "key_lookups": f"""WITH {NORMAL_SQL}
SELECT row_number, CAST(st.store_id IS NOT NULL AS INT) AS store_known,
       CAST(pr.product_id IS NOT NULL AS INT) AS product_known, unit_price_cents
FROM normal n LEFT JOIN stores st ON st.store_id = n.store_id
LEFT JOIN products pr ON pr.product_id = n.product_id""",
    "checked_sales": f"""WITH {CHECKED_SQL}
SELECT row_number, copies_removed, cents AS amount_cents,
       CASE WHEN imputed THEN 'imputed' ELSE 'reported' END AS amount_source,
       CAST(imputed AS INT) AS is_imputed, reasons
FROM checked""",
    "valid_sales": f"""WITH {CHECKED_SQL}
SELECT row_number, order_id, date, store_id, product_id, qty, cents AS amount_cents,
       CASE WHEN imputed THEN 'imputed' ELSE 'reported' END AS amount_source, payment
FROM checked WHERE reasons = ''""",
    "quarantine": f"""WITH {CHECKED_SQL}
SELECT row_number, CAST(json_object('amount', r6, 'date', r2, 'order_id', r1, 'payment', r7, 'product_id', r4,
       'qty', r5, 'store_id', r3) AS VARCHAR) AS raw_json, reasons
FROM checked WHERE reasons <> ''""",
    "reason_counts": f"WITH {CHECKED_SQL} SELECT reason, occurrences FROM counted",
    "ingestion_summary": f"""WITH {CHECKED_SQL}
SELECT summary.*, (SELECT '{{' || string_agg('"' || reason || '":' || CAST(occurrences AS VARCHAR), ',' ORDER BY reason)
       || '}}' FROM counted) AS issue_counts
FROM summary""",
    "quality_score": f"""WITH {CHECKED_SQL}
SELECT (200 * valid_sales + raw_sales - duplicate_rows_removed)
       // (2 * (raw_sales - duplicate_rows_removed)) AS quality_score
FROM summary""",
    "conservation_check": f"""WITH {CHECKED_SQL},
sums AS (SELECT CAST(sum(occurrences) AS BIGINT) AS n FROM counted)
SELECT raw_sales - duplicate_rows_removed AS distinct_rows, valid_sales + quarantined_sales AS outcome_rows,
       n AS reason_occurrences,
       CAST(raw_sales - duplicate_rows_removed = valid_sales + quarantined_sales
            AND n >= quarantined_sales AS INT) AS holds
FROM summary, sums""",
}
