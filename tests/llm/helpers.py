"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet " * 4000


def awkward(spark, repeats: int = 1):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (None, "no identifier at all here", "de", "b", 3),
        (None, None, None, None, None),
        (6, LONG, "en", "c", len(LONG)),
        (2**62 + 1, "Übergrößenträger \U0001f600 naïve café", "de", None, 2),
        (8, "one", "en", "a", 3),
    ] * repeats
    frame = spark.createDataFrame(rows, DOCS).coalesce(2)
    names = ("shard", "slot", "value", "row_number", "kept", "root", "size", "length")
    for name in (*names, "_kept", "_tie", "_part", "_place", "_cuts", "_removed", "_row_file", "_row_place"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)
