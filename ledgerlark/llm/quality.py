"""Quality rules: counts within a text, and lines that many documents of a host share.

Lines are normalised and hashed; for each host the distinct documents with a
line are counted.  A line above the limit, a share of the host's documents and
a floor, is frequent.  A document with too little left once boilerplate is
removed is rejected.

Copies must not turn each other into boilerplate.  Equal texts count as one
document.  In near copies a line stands between the same lines nearly
everywhere, while a shared block stands between different ones.  So a frequent
line opens a block if the lines before it differ, and belongs to one if the
line that is before it in most documents does; likewise from the end.  That is
a pointer from each frequent line to the one before it, which jumps until it
meets a line that opens a block or has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, apart, located, small_side, stored

#: Contract of the rules within a text.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Distinct documents of a host that may share a line: a share of them, and so many anyway.
MAX_PERCENT, FLOOR = 1, 10
#: Words that a line which opens a block has at least.
MIN_LINE_WORDS = 3
#: Share of a document's words that must be left.
MIN_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, single spaces, no space at the ends."""
    spaced = F.trim(F.regexp_replace(F.lower(line), SPACES, " "))
    return F.translate(spaced, "123456789", "000000000")


def _windows(hashes: str) -> Column:
    """Hashes of all windows of ``WINDOW`` words; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    window = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)])
    return F.when(F.size(hashes) >= WINDOW, F.transform(at, window)).otherwise(
        F.array().cast("array<bigint>")
    )


def _repeated_places(windows: str) -> Column:
    """Sorted places of windows found twice or more; null if there are none."""
    placed = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(F.col(windows))) < F.size(windows), F.sort_array(placed))


def _covered(places: str) -> Column:
    """Words in any of the windows at ``places``: each adds those before the next one starts."""
    gaps = F.transform(
        F.col(places),
        lambda p, k: F.coalesce(F.least(F.get(F.col(places), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    return F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0).cast("long"))


def counts_within(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines.

    ``lines`` has (h, words) of the lines with a word, in order.  Null counts
    as empty.  All of it is built-in expressions over one row; windows are
    compared by 64-bit hash within their text.
    """
    step = rows.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumns(
        {"_words": words_of(F.col("_t")), "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}
    )
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_windows", _windows("_hashes")).withColumn("_sorted", _repeated_places("_windows"))
    again = F.filter(
        F.col("_sorted"),
        lambda x, k: (F.get(F.col("_sorted"), k + 1)["h"].eqNullSafe(x["h"]))
        | ((k > 0) & F.get(F.col("_sorted"), F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(x["h"])),
    )
    step = step.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    counted = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered("_places"),
            "lines": F.transform(
                "_lines",
                lambda x: F.struct(
                    F.xxhash64(normalised_line(x)).alias("h"), F.size(words_of(x)).alias("words")
                ),
            ),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop(
        "_t", "_words", "_lines", "_hashes", "_windows", "_sorted", "_places"
    )


def _of_a_block(lines: DataFrame, opens: str, pointer: str) -> DataFrame:
    """(host, h) of the lines that open a block, or whose pointers lead to one that does.

    A pointer jumps to its target's pointer in each round, so rounds are at
    most the logarithm of the number of lines; lines that point in a circle
    lead nowhere.
    """
    state = stored(
        lines.select("host", "h", F.col(opens).alias("found"), F.when(~F.col(opens), F.col(pointer)).alias("to")),
        "line-pointers",
    )
    for _ in range(max(1, state.count()).bit_length()):
        target = state.select("host", F.col("h").alias("to"), F.col("found").alias("there"), F.col("to").alias("next"))
        state = stored(
            state.join(target, ["host", "to"], "left").select(
                "host", "h", (F.col("found") | F.coalesce("there", F.lit(False))).alias("found"),
                F.when(F.col("found") | F.coalesce("there", F.lit(False)), None).otherwise(F.col("next")).alias("to"),
            ),
            "line-jumps",
        )
        if not state.where("to is not null").take(1):
            break
    return state.where("found").select("host", "h")


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(host, h) of boilerplate among ``rows`` (host, text_hash, lines)."""
    around = F.transform(
        "lines",
        lambda x, i: F.struct(
            x["h"].alias("h"),
            x["words"].alias("words"),
            F.get(F.col("lines"), F.greatest(i - 1, F.lit(0)))["h"].alias("before"),
            F.get(F.col("lines"), i + 1)["h"].alias("after"),
            (i == 0).alias("first"),
        ),
    )
    met = rows.select("host", "text_hash", F.explode(around).alias("x")).select(
        "host",
        "text_hash",
        "x.h",
        "x.words",
        F.when(~F.col("x.first"), F.col("x.before")).alias("before"),
        "x.after",
    )
    documents = rows.groupBy("host").agg(F.count_distinct("text_hash").alias("of"))
    limits = documents.select("host", F.greatest(F.lit(FLOOR), F.col("of") * MAX_PERCENT / 100).alias("limit"))
    limits = small_side(stored(limits, "host-limits"), F.length("host") + 24)
    often = met.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FLOOR)
    often = small_side(stored(often.join(limits, "host").where("n > limit").select("host", "h"), "frequent-lines"), 40)
    met = stored(met.join(often, ["host", "h"]), "frequent-met")
    counted = met.groupBy("host", "h").agg(
        F.count_distinct("text_hash").alias("documents"), F.max("words").alias("words"),
        F.count_distinct("before").alias("befores"), F.count_distinct("after").alias("afters"),
    )
    counted = stored(counted.join(limits, "host").where("documents > limit"), "line-counts")

    def common(side: str) -> DataFrame:
        """(host, h, side): the neighbour that a line has in over half of its documents."""
        return (
            met.groupBy("host", "h", side)
            .agg(F.count_distinct("text_hash").alias("n"))
            .join(counted.select("host", "h", "documents"), ["host", "h"])
            .where(F.col(side).isNotNull() & (2 * F.col("n") > F.col("documents")))
            .select("host", "h", side)
        )

    long = F.col("words") >= MIN_LINE_WORDS
    lines = counted.select(
        "host", "h", (long & (2 * F.col("befores") >= F.col("documents"))).alias("opens"),
        (long & (2 * F.col("afters") >= F.col("documents"))).alias("closes"),
    )
    lines = lines.join(common("before"), ["host", "h"], "left").join(common("after"), ["host", "h"], "left")
    lines = stored(lines, "line-neighbours")
    return _of_a_block(lines, "opens", "before").unionByName(_of_a_block(lines, "closes", "after")).distinct()


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """One row per document: its place, doc_id, the counts, base_failed, removed (hashes of
    lines), n_removed_words, kept.

    A null host and the empty host are one.  Null, empty and blank texts have
    no words: base_failed.  A document is kept if it passes the base rules and
    has ``MIN_WORDS`` words and a share ``MIN_LEFT`` of its words left.
    Repeated rows are judged alike.  An empty table gives no rows.
    """
    narrow = located(docs).select(
        *PLACE,
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    rows = stored(counts_within(narrow, "text").drop("text"), "line-hashes")
    boilerplate = small_side(stored(frequent_lines(rows), "boilerplate"), 40)
    removed = (
        rows.select(*PLACE, "host", F.explode("lines").alias("x"))
        .select(*PLACE, "host", "x.h", "x.words")
        .join(boilerplate, ["host", "h"])
        .groupBy(*PLACE)
        .agg(F.collect_set("h").alias("removed"), F.sum("words").alias("n_removed_words"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        rows.drop("lines", "host", "text_hash")
        .join(removed, PLACE, "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn(
            "kept",
            ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= MIN_LEFT * F.col("n_words")),
        )
    )


@apart
def quality(docs: DataFrame) -> DataFrame:
    """The verdicts of ``judged`` without places and line hashes."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words",
    )


@apart
def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` without rejected documents, and without boilerplate lines in the others.

    Only rows that change are joined; all columns stay, and ``length_col``
    follows the text where a line went.
    """
    rows = located(docs)
    verdicts = stored(
        judged(rows).where(~F.col("kept") | F.col("removed").isNotNull()).select(*PLACE, "kept", "removed"),
        "verdicts",
    )
    changed = small_side(verdicts, F.coalesce(F.size("removed"), F.lit(0)) * 8 + 40)
    joined = rows.join(changed.withColumnsRenamed({"kept": "_kept", "removed": "_removed"}), PLACE, "left")
    staying = joined.where(F.coalesce("_kept", F.lit(True)))
    lines = F.filter(
        F.split(F.col(text_col), "\n"),
        lambda x: ~(
            x.rlike(r"[^\x20\x09-\x0D]")
            & F.array_contains(F.col("_removed"), F.xxhash64(normalised_line(x)))
        ),
    )
    touched = F.col("_removed").isNotNull()
    out = staying.withColumn(text_col, F.when(touched, F.array_join(lines, "\n")).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(
            length_col, F.when(touched, F.length(text_col).cast(kind)).otherwise(F.col(length_col))
        )
    return out.select(*docs.columns)
