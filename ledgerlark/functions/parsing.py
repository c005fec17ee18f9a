"""Parsing of dates, whole numbers and money.  NULL means "cannot be read"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.fixed import CURRENCY_SIGN, DATE_SHAPES, DECIMAL_SHAPE, INTEGER_SHAPE
from ledgerlark.functions.text import strip


def parse_date(text: Column) -> Column:
    cleaned = strip(text)
    parsed = F.coalesce(
        *(
            F.when(cleaned.rlike(shape), F.try_to_date(cleaned, pattern))
            for shape, pattern in DATE_SHAPES
        )
    )
    # The calendar of the facts starts with year 1.
    return F.when(parsed >= F.lit("0001-01-01").cast("date"), parsed)


def parse_whole(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(cleaned.rlike(INTEGER_SHAPE), cleaned.try_cast("bigint"))


def parse_cents(text: Column) -> Column:
    """Money text to whole cents, half away from zero.

    Rounding to two places looks at the third decimal only, so digits far
    behind it are cut first: they would not fit the decimal type and a second
    rounding must not happen.
    """
    cleaned = strip(F.regexp_replace(strip(text), "^" + CURRENCY_SIGN, ""))
    short = F.regexp_replace(cleaned, r"^([+-]?[0-9]*\.[0-9]{10})[0-9]+$", "$1")
    amount = F.when(cleaned.rlike(DECIMAL_SHAPE), short.try_cast("decimal(38,18)"))
    return (F.round(amount, 2) * 100).try_cast("bigint")
