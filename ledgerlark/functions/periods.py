"""Calendar helpers as Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.fixed import MONTH_LABELS


def day(value: date) -> Column:
    """A date as a literal, for any year."""
    return F.lit(value.isoformat()).cast("date")


def previous_period(start: Column, end: Column) -> tuple[Column, Column]:
    """The range of equal length that ends the day before ``start``."""
    before = F.date_sub(start, 1)
    return F.date_sub(start, F.datediff(end, start) + 1), before


def month_range(year: Column, month: Column) -> tuple[Column, Column]:
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)


def month_of(when: Column) -> Column:
    return F.trunc(when, "MM")


def previous_month(when: Column) -> Column:
    return F.add_months(month_of(when), -1)


def months_between(start: Column, end: Column) -> Column:
    """First days of all months that ``start..end`` touches; empty if reversed."""
    return F.when(
        start <= end, F.sequence(month_of(start), month_of(end), F.expr("interval 1 month"))
    )


def month_label(when: Column) -> Column:
    return F.element_at(F.array(*(F.lit(label) for label in MONTH_LABELS)), F.month(when))


def iso(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd")
