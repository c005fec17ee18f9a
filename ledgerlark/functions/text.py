"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.fixed import WHITESPACE


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def normal_id(text: Column) -> Column:
    return F.upper(strip(text))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(or_, (text.contains(word) for word in words))


def fill_sentence(sentence: str, *values: Column) -> Column:
    """Put values, in order, where the sentence has ``%s``."""
    return F.format_string(sentence, *values)
