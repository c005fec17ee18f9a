"""Scalar functions against Python's own arithmetic and calendar."""

from __future__ import annotations

import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.fixed import WHITESPACE
from ledgerlark.functions import parsing, periods, rounding, text


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [row.out for row in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "2026-05-01": date(2026, 5, 1),
        "01-05-2026": date(2026, 5, 1),
        "2026/05/01": date(2026, 5, 1),
        " 2026-5-1　": date(2026, 5, 1),
        "1-5-2026": date(2026, 5, 1),
        "05/01/2026": None,
        "13/45/2024": None,
        "2026-02-30": None,
        "2026-13-01": None,
        "2026-005-01": None,
        "26-05-01": None,
        "12026-05-01": None,
        "0000-01-01": None,
        "0001-01-01": date(1, 1, 1),
        "２０２６-05-01": None,
        "2026-05-01x": None,
        "": None,
    }
    assert column(spark, cases, parsing.parse_date) == list(cases.values())


def test_money(spark):
    cases = {
        "66.00": 6600,
        "¥66.00": 6600,
        " ¥ 66.00 ": 6600,
        "12.345": 1235,
        "-12.345": -1235,
        "12.344999999999999999999999999999": 1234,
        "12.345000000000000000000000000001": 1235,
        "¥-5": -500,
        ".5": 50,
        "5.": 500,
        "+5": 500,
        "1.5e2": 15000,
        "-¥5": None,
        "￥5": None,
        "¥¥5": None,
        "1,234.00": None,
        "１２": None,
        "1_000": None,
        "NaN": None,
        "Infinity": None,
        "1E30": None,
        "¥": None,
        "": None,
        "abc": None,
    }
    assert column(spark, cases, parsing.parse_cents) == list(cases.values())


def test_whole_numbers(spark):
    cases = {
        " 5 ": 5, "+5": 5, "-3": -3, "007": 7, "3.0": None, "x": None, "": None,
        "1_000": None, "２": None, "9223372036854775808": None,
    }
    assert column(spark, cases, parsing.parse_whole) == list(cases.values())


def test_strip_removes_what_python_removes(spark):
    padded = [f"{blank}a {blank}" for blank in WHITESPACE]
    assert column(spark, padded, text.strip) == [value.strip() for value in padded]
    assert column(spark, [" s01\t"], text.normal_id) == ["S01"]


def half_up(value: Decimal, step: str) -> Decimal:
    return value.quantize(Decimal(step), rounding=ROUND_HALF_UP)


def number_pairs():
    source = random.Random(3)
    pairs = [(source.randint(-10**6, 10**6), source.randint(-300, 300)) for _ in range(1500)]
    pairs += [(n * d // 2, d) for n in range(-21, 22) for d in (2, 4, 6, 8)]
    pairs += [(10**18, 3), (-(10**18), 7), (5 * 10**17, 10**18), (1, 0), (0, 5), (-1, 2), (1, -2)]
    return pairs


def pair_frame(spark):
    return spark.createDataFrame(number_pairs(), "n long, d long")


def test_average(spark):
    rows = pair_frame(spark).select("n", "d", rounding.average_cents(F.col("n"), F.col("d")).alias("out"))
    for n, d, out in rows.collect():
        assert out == (int(half_up(Decimal(n) / Decimal(d), "1")) if d else None), (n, d)


def test_percent_change(spark):
    rows = pair_frame(spark).select(
        "n", "d", rounding.percent_change(F.col("n"), F.col("d")).alias("out")
    )
    for now, before, out in rows.collect():
        if before == 0:
            assert out is None
        else:
            exact = (Decimal(now) - Decimal(before)) * 1000 / Decimal(before)
            assert out == float(half_up(exact, "1") / 10), (now, before)


def test_share(spark):
    rows = pair_frame(spark).select(
        "n", "d", rounding.share_percent(F.col("n"), F.col("d")).alias("out")
    )
    for part, total, out in rows.collect():
        wanted = float(half_up(Decimal(part) * 1000 / Decimal(total), "1") / 10) if total else 0.0
        assert out == wanted, (part, total)


@pytest.mark.parametrize(
    ("now", "before", "change", "way"),
    [(None, 5, None, "flat"), (5, None, None, "flat"), (5, 0, None, "up"), (5, 5, 0.0, "flat"),
     (3000, 500, 500.0, "up"), (1, 3, -66.7, "down"), (5, -10, -150.0, "up")],
)
def test_change_and_direction(spark, now, before, change, way):
    row = spark.createDataFrame([(now, before)], "n long, b long").select(
        rounding.percent_change(F.col("n"), F.col("b")), rounding.direction(F.col("n"), F.col("b"))
    )
    assert tuple(row.first()) == (change, way)


def test_quality_percent(spark):
    rows = spark.createDataFrame([(11944, 12055), (1, 200), (0, 3), (5, 0), (0, -1)], "v long, d long")
    found = rows.select(rounding.whole_percent(F.col("v"), F.col("d")).alias("out")).collect()
    assert [row.out for row in found] == [99, 1, 0, None, None]


def test_money_text(spark):
    cases = {0: "¥0.00", 5: "¥0.05", 123456: "¥1,234.56", -123456: "¥-1,234.56", 42963700: "¥429,637.00"}
    cases[10**17 + 1] = "¥1,000,000,000,000,000.01"
    assert column(spark, cases, rounding.money_text, "long") == list(cases.values())
    assert column(spark, [None], rounding.money_text, "long") == [None]


def test_periods(spark):
    row = spark.createDataFrame([(date(2026, 5, 1), date(2026, 5, 31))], "a date, b date").select(
        *periods.previous_period(F.col("a"), F.col("b")),
        *periods.month_range(F.lit(2024), F.lit(2)),
        periods.previous_month(F.lit(date(2026, 1, 15))),
        periods.month_label(F.lit(date(2026, 11, 1))),
        periods.iso(F.col("a")),
    )
    assert tuple(row.first()) == (
        date(2026, 3, 31), date(2026, 4, 30), date(2024, 2, 1), date(2024, 2, 29),
        date(2025, 12, 1), "十一月", "2026-05-01",
    )
