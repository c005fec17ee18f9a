"""Cleaning of raw sales: exact duplicates, parsing, rules, outcome.

Input is a frame of raw strings (``SALES_FIELDS``) with a ``row_number`` and
two cleaned dimensions: ``stores`` (store_id) and ``products`` (product_id,
unit_price_cents), each unique on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.fixed import SALES_FIELDS
from ledgerlark.functions.parsing import parse_cents, parse_date, parse_whole
from ledgerlark.functions.text import normal_id, strip
from ledgerlark.operators.filters import broadcast_if_small


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Key values that more than one row has, and how many rows."""
    return table.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def drop_exact_duplicates(raw: DataFrame) -> DataFrame:
    """One row per distinct raw record: the first, and how many copies went.

    All fields are the grouping key, so the group is the kept row.  Copies
    collapse before the shuffle; a record that fills a third of the input
    reaches the other side as one row per map task.
    """
    return raw.groupBy(*SALES_FIELDS).agg(
        F.min("row_number").alias("row_number"),
        (F.count("*") - 1).alias("copies_removed"),
    )


def normalized(raw: DataFrame) -> DataFrame:
    """Parsed columns next to each raw row; NULL where a text cannot be read."""
    return raw.select(
        "*",
        strip(F.col("order_id")).alias("clean_order_id"),
        parse_date(F.col("date")).alias("clean_date"),
        normal_id(F.col("store_id")).alias("clean_store_id"),
        normal_id(F.col("product_id")).alias("clean_product_id"),
        parse_whole(F.col("qty")).alias("clean_qty"),
        parse_cents(F.col("amount")).alias("reported_cents"),
        (strip(F.col("amount")) == "").alias("amount_is_blank"),
        strip(F.col("payment")).alias("clean_payment"),
    )


def with_key_lookups(rows: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Look up store and product; unmatched rows stay, with NULLs.

    Both are measured before they are broadcast: one blank or usual key may
    hold most rows.
    """
    known_stores = stores.select(
        F.col("store_id").alias("clean_store_id"), F.lit(True).alias("store_known")
    )
    prices = products.select(
        F.col("product_id").alias("clean_product_id"),
        "unit_price_cents",
        F.lit(True).alias("product_known"),
    )
    return rows.join(broadcast_if_small(known_stores), "clean_store_id", "left").join(
        broadcast_if_small(prices), "clean_product_id", "left"
    )


def _reasons(unresolved: dict[str, Column]) -> Column:
    """The names whose condition holds, in alphabetical order."""
    return F.array_compact(
        F.array(*(F.when(unresolved[name], F.lit(name)) for name in sorted(unresolved)))
    )


def checked(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Every distinct raw row with its cleaned values and its reason codes.

    A row without reasons is trusted.  ``is_imputed`` is kept for rows that
    end in quarantine for another reason.
    """
    rows = with_key_lookups(normalized(drop_exact_duplicates(raw)), stores, products)

    qty, price = F.col("clean_qty"), F.col("unit_price_cents")
    expected = F.try_multiply(qty, price)
    blank = F.col("amount_is_blank")
    imputable = F.coalesce(blank & (qty > 0) & expected.isNotNull(), F.lit(False))
    rows = rows.select(
        "*",
        imputable.alias("is_imputed"),
        expected.alias("expected_cents"),
        F.when(imputable, expected).when(~blank, F.col("reported_cents")).alias("amount_cents"),
    )

    cents = F.col("amount_cents")
    first_pass = _reasons(
        {
            "unknown_store": F.col("store_known").isNull(),
            "unknown_product": F.col("product_known").isNull(),
            "invalid_date": F.col("clean_date").isNull(),
            "invalid_quantity": qty.isNull(),
            "invalid_amount": ~blank & F.col("reported_cents").isNull(),
            "missing_amount": blank & ~F.col("is_imputed"),
            "zero_quantity_nonzero_amount": (qty == 0) & (cents != 0),
            "quantity_amount_sign_conflict": ((qty < 0) & (cents > 0))
            | ((qty > 0) & (cents < 0)),
            "zero_value_transaction": (qty == 0) & (cents == 0),
        }
    )
    rows = rows.withColumn("other_reasons", first_pass)

    # The price is compared only when nothing else is wrong with the row.
    off_price = (F.size("other_reasons") == 0) & ~cents.eqNullSafe(F.col("expected_cents"))
    reasons = F.when(off_price, F.array(F.lit("amount_unit_price_mismatch"))).otherwise(
        F.col("other_reasons")
    )
    return rows.select(
        "row_number",
        *SALES_FIELDS,
        "copies_removed",
        "clean_order_id",
        "clean_date",
        "clean_store_id",
        "clean_product_id",
        "clean_qty",
        "amount_cents",
        F.when(F.col("is_imputed"), "imputed").otherwise("reported").alias("amount_source"),
        "clean_payment",
        "is_imputed",
        reasons.alias("reasons"),
    )


def raw_json() -> Column:
    """The raw record as JSON, keys in order."""
    return F.to_json(F.struct(*(F.col(name) for name in sorted(SALES_FIELDS))))


def is_trusted() -> Column:
    return F.size("reasons") == 0


def valid_sales(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.where(is_trusted()).select(
        "row_number",
        F.col("clean_order_id").alias("order_id"),
        F.col("clean_date").alias("date"),
        F.col("clean_store_id").alias("store_id"),
        F.col("clean_product_id").alias("product_id"),
        F.col("clean_qty").alias("qty"),
        "amount_cents",
        "amount_source",
        F.col("clean_payment").alias("payment"),
    )


def quarantined_sales(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.where(~is_trusted()).select(
        "row_number", raw_json().alias("raw_json"), "reasons"
    )


def outcomes(checked_rows: DataFrame) -> DataFrame:
    """Both outcomes in one frame, so that one write serves both tables.

    Trusted rows carry the cleaned values, quarantined rows the raw record.
    """
    trusted = is_trusted()

    def when_trusted(column: str, name: str) -> Column:
        return F.when(trusted, F.col(column)).alias(name)

    return checked_rows.select(
        "row_number",
        when_trusted("clean_order_id", "order_id"),
        when_trusted("clean_store_id", "store_id"),
        when_trusted("clean_product_id", "product_id"),
        when_trusted("clean_qty", "qty"),
        when_trusted("amount_cents", "amount_cents"),
        when_trusted("amount_source", "amount_source"),
        when_trusted("clean_payment", "payment"),
        "copies_removed",
        "is_imputed",
        "reasons",
        F.when(~trusted, raw_json()).alias("raw_json"),
        F.when(trusted, "valid").otherwise("quarantined").alias("outcome"),
        when_trusted("clean_date", "date"),
    )
