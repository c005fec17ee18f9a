"""Averages, percentages and money text in exact integer arithmetic.

Sums over very large inputs times 2,000 can pass 64 bits, so the numerators
are DECIMAL(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.fixed import CURRENCY_SIGN

_WIDE = "decimal(38,0)"


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Quotient of non-negative ``numerator`` and positive ``denominator``.

    The remainder is taken off first, so the division has no digits to lose.
    """
    doubled = F.lit(2).cast(_WIDE)
    top = (doubled * numerator + denominator).cast(_WIDE)
    bottom = (doubled * denominator).cast(_WIDE)
    return ((top - top % bottom) / bottom).cast(_WIDE)


def _signed_half_up(numerator: Column, denominator: Column) -> Column:
    negative = (numerator < 0) != (denominator < 0)
    size = _half_up(F.abs(numerator), F.abs(denominator))
    return F.when(negative, -size).otherwise(size)


def average_cents(revenue: Column, orders: Column) -> Column:
    average = _signed_half_up(revenue.cast(_WIDE), orders.cast(_WIDE))
    return F.when(orders != 0, average.cast("bigint"))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent with one decimal; NULL without a usable baseline."""
    now, before = current.cast(_WIDE), previous.cast(_WIDE)
    tenths = _signed_half_up(((now - before) * F.lit(1000)).cast(_WIDE), before)
    return F.when(current.isNotNull() & (previous != 0), tenths.cast("double") / F.lit(10.0))


def share_percent(part: Column, total: Column) -> Column:
    tenths = _signed_half_up((part.cast(_WIDE) * F.lit(1000)).cast(_WIDE), total.cast(_WIDE))
    return F.when(total != 0, tenths.cast("double") / F.lit(10.0)).otherwise(F.lit(0.0))


def whole_percent(part: Column, whole: Column) -> Column:
    """Share in whole percent; NULL unless ``whole`` is positive."""
    percent = _half_up((part.cast(_WIDE) * F.lit(100)).cast(_WIDE), whole.cast(_WIDE))
    return F.when(whole > 0, percent.cast("bigint"))


def direction(current: Column, previous: Column) -> Column:
    return (
        F.when(current > previous, "up").when(current < previous, "down").otherwise("flat")
    )


def money_text(cents: Column) -> Column:
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(cents.cast("decimal(20,0)") / 100, 2))
