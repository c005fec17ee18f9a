"""Questions in natural language: history, intent and arguments.

Input is one row per message: ``conv_id, turn, role, text``.  All rules are
Column expressions; the first rule that applies decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark import fixed
from ledgerlark.functions.periods import iso, month_of, month_range, previous_month
from ledgerlark.functions.text import contains_any, strip
from ledgerlark.operators.filters import broadcast_if_small
from ledgerlark.session import stored
from ledgerlark.sources.star import SalesStar

PLANNED, UNSUPPORTED, INVALID = "planned", "unsupported", "invalid"

# Turns per block: a conversation is cut into blocks of this many turns, so
# that a very long one is spread over many tasks.
BLOCK_TURNS = 100_000
# Letters per chunk of a text in which product names are looked for.
CHUNK_LETTERS = 128


def with_history(messages: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Adds ``history``: the up to eight messages before each message.

    The window runs inside blocks of a conversation.  A block's last messages
    are handed on to the blocks after it, by conversation and block: one small
    row per block, so no message meets another by its conversation alone.
    Conversations that stay in their first block hand on nothing.
    """
    size = fixed.MAX_HISTORY
    message = F.struct("turn", "role", "text")
    blocked = messages.withColumn("block", F.floor(F.col("turn") / block_turns))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn")
    rows = blocked.withColumn("near", F.collect_list(message).over(in_block.rowsBetween(-size, -1)))

    # a row per block beyond the first: as many as turns over block_turns
    later = stored(
        blocked.where(F.col("block") != 0).groupBy("conv_id", "block").agg(F.min("turn").alias("first")), "later-blocks"
    )
    if not later.take(1):
        return rows.select(*messages.columns, F.col("near").alias("history"))
    last_first = Window.partitionBy("conv_id", "block").orderBy(F.desc("turn"))
    long = broadcast_if_small(later.select("conv_id").distinct())
    tails = (
        blocked.join(long, "conv_id", "left_semi")
        .withColumn("from_end", F.row_number().over(last_first))
        .where(F.col("from_end") <= size)
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(message)).alias("tail"))
    )
    # A block holds at least one message, so eight blocks are always enough.
    blocks_before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(-size, -1)
    handed_on = tails.select(
        "conv_id", "block", F.flatten(F.collect_list("tail").over(blocks_before)).alias("far")
    ).where(F.size("far") > 0)
    needing = F.size("near") < size
    both = F.concat("far", "near")
    carried = (
        rows.where(needing)
        .join(handed_on, ["conv_id", "block"], "left")
        .withColumn("both", F.coalesce(both, F.col("near")))
        .select(*messages.columns, F.when(F.size("both") > size, F.slice("both", -size, size)).otherwise(F.col("both")).alias("history"))
    )
    return carried.unionByName(rows.where(~needing).select(*messages.columns, F.col("near").alias("history")))


def _length_between(text: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(text).between(low, high), F.lit(False))


def questions(messages_with_history: DataFrame) -> DataFrame:
    """The user's messages as requests, each with its check."""
    acceptable = F.forall(
        "history",
        lambda m: m["role"].isin(*fixed.CHAT_ROLES)
        & _length_between(m["text"], 1, fixed.MAX_MESSAGE_CHARS),
    ) & (F.size("history") <= fixed.MAX_HISTORY)
    asked = messages_with_history.where(F.col("role") == "user")
    return asked.select(
        "conv_id",
        "turn",
        strip(F.col("text")).alias("current"),
        F.array_join(F.transform("history", lambda m: m["text"]), " ").alias("context"),
        F.transform("history", lambda m: m["text"]).alias("said"),
        (F.size("history") > 0).alias("has_history"),
        F.when(~_length_between(F.col("text"), 1, fixed.MAX_QUESTION_CHARS), "question length")
        .when(~acceptable, "history")
        .alias("problem"),
    )


def month_number(text: Column) -> Column:
    """Month named in the text; longer labels first, as one ends in another."""
    labels = sorted(enumerate(fixed.MONTH_LABELS, 1), key=lambda item: -len(item[1]))
    return F.coalesce(*(F.when(text.contains(label), number) for number, label in labels))


def longest_product(texts: DataFrame, products: DataFrame, *ids: str) -> DataFrame:
    """The longest product name that occurs in ``text``, per ``ids``.

    Equally long names go by product id.  Names are not compared with every
    text: two letters at each place select the lengths worth trying, and each
    piece of such a length is looked up by equality.
    """
    names = (
        products.where(F.col("product_name") != "")
        .groupBy("product_name")
        .agg(F.min("product_id").alias("first_id"))
        .withColumn("length", F.length("product_name"))
    )
    longest = names.agg(F.max("length")).scalar()
    # Texts are cut into short overlapping chunks, so that reaching a place in
    # one stays cheap; a name starts in exactly one chunk.
    size = F.lit(CHUNK_LETTERS)
    chunks = (
        texts.where(F.col("text") != "")
        .select(
            *ids,
            "text",
            F.explode(F.sequence(F.lit(1), F.length("text"), size)).alias("start"),
        )
        .select(*ids, F.substring("text", F.col("start"), size + longest).alias("chunk"))
    )
    pieces = chunks.select(
        *ids,
        "chunk",
        F.explode(F.sequence(F.lit(1), F.least(F.length("chunk"), size))).alias("place"),
    ).withColumn("opening", F.substring("chunk", F.col("place"), F.lit(2)))
    openings = (
        names.where(F.col("length") > 1)
        .groupBy(F.substring("product_name", 1, 2).alias("opening"))
        .agg(F.collect_set("length").alias("lengths"))
    )
    single = names.where(F.col("length") == 1).select(
        F.col("product_name").alias("letter"), F.array("length").alias("one")
    )
    nothing = F.array().cast("array<int>")
    lengths = F.concat(F.coalesce("lengths", nothing), F.coalesce("one", nothing))
    candidates = (
        pieces.withColumn("letter", F.substring("opening", 1, 1))
        .join(broadcast_if_small(openings), "opening", "left")
        .join(broadcast_if_small(single), "letter", "left")
        .select(*ids, "chunk", "place", F.explode(lengths).alias("length"))
        .select(*ids, F.substring("chunk", F.col("place"), F.col("length")).alias("product_name"))
    )
    best = F.struct(-F.col("length"), F.col("first_id"))
    return (
        candidates.distinct()
        .join(broadcast_if_small(names), "product_name")
        .groupBy(*ids)
        .agg(F.min_by("product_name", best).alias("product_name"))
    )


def product_in_context(asked: DataFrame, products: DataFrame) -> DataFrame:
    """The longest product name in what was ``said`` and the ``current`` text, per conv_id and turn.

    The texts are joined by blanks.  A name lies within one of them or across a
    seam, so each text is searched, and the surroundings of each seam as far as
    the longest name reaches.  Up to nine questions share a text and its seams,
    and equal texts are one: every one is searched once.
    """
    ids = ["conv_id", "turn"]
    names = products.where(F.col("product_name") != "")
    longest, blanks = names.agg(F.max(F.length("product_name")), F.max(F.col("product_name").contains(" "))).first()
    if longest is None:
        return asked.select(*ids, F.lit(None).cast("string").alias("product_name")).where("false")
    said = F.when(F.size("said") == 0, F.array(F.lit(""))).otherwise(F.col("said"))
    rows = asked.select(*ids, F.concat(said, F.array("current")).alias("texts"))
    parts = F.col("texts")
    if blanks:
        reach = F.lit(longest - 1)
        joined = lambda first, n: F.array_join(F.slice("texts", first, n), " ")
        seam = lambda k: F.concat(
            F.right(joined(F.lit(1), k), reach), F.lit(" "), F.left(joined(k + 1, F.size("texts")), reach)
        )
        parts = F.concat(parts, F.transform(F.sequence(F.lit(1), F.size("texts") - 1), seam))
    searched = rows.select(*ids, F.explode(F.array_distinct(parts)).alias("text")).where(F.col("text") != "")
    distinct = stored(
        searched.select("text").distinct().withColumn("part", F.monotonically_increasing_id()), "searched-texts"
    )
    found = distinct.join(longest_product(distinct, products, "part"), "part").select("text", "product_name")
    order = names.groupBy("product_name").agg(F.min("product_id").alias("first_id"))
    best = F.struct(-F.length("product_name"), F.col("first_id"))
    found = stored(found.join(broadcast_if_small(order), "product_name"), "found-products")
    return searched.join(broadcast_if_small(found), "text").groupBy(*ids).agg(
        F.min_by("product_name", best).alias("product_name")
    )


def _arguments(**values: Column) -> Column:
    return F.to_json(F.struct(*(value.alias(name) for name, value in values.items())))


def plan(asked: DataFrame, star: SalesStar) -> DataFrame:
    """Tool and arguments for each question, or why there is none.

    Month names mean the year of the last sale.  "Recent" compares the month
    of the last sale, complete or not, with the month before.  The questions
    are written once: the product search and the result both read them.
    """
    date_min = star.sales.agg(F.min("date")).scalar()
    date_max = star.sales.agg(F.max("date")).scalar()
    current = F.col("current")

    month = F.coalesce(month_number(current), month_number(F.col("context")))
    wants_amount = contains_any(current, fixed.AMOUNT_WORDS)
    follows_up = (
        F.col("month").isNotNull()
        & current.contains(fixed.FOLLOW_UP_WORD)
        & F.col("has_history")
    )
    intent = (
        F.when(F.col("problem").isNotNull(), INVALID)
        .when(F.col("date_max").isNull(), "no_dates")
        .when(contains_any(current, fixed.QUALITY_WORDS), "get_data_quality")
        .when(
            current.contains(fixed.ORDER_VALUE_WORD) & contains_any(current, fixed.CHANGE_WORDS),
            "compare_periods",
        )
        .when(
            current.contains(fixed.CATEGORY_WORD) & contains_any(current, fixed.RANKING_WORDS),
            "get_top_entities",
        )
        .when(wants_amount | follows_up, "get_revenue")
    )
    understood = asked.withColumns({"month": month, "date_min": date_min, "date_max": date_max}).withColumn("intent", intent)
    # A question's history repeats up to eight texts; only those searched for a name take them along.
    searched = F.col("intent") == "get_revenue"
    rows = stored(
        understood.select(
            "conv_id",
            "turn",
            "problem",
            "month",
            "date_min",
            "date_max",
            "intent",
            current.contains(fixed.STORE_WORD).alias("by_store"),
            F.when(searched, current).alias("current"),
            F.when(searched, F.col("said")).alias("said"),
        ),
        "questions",
    )
    # Only questions that reach the product rule are searched for a name.
    found = product_in_context(rows.where(F.col("intent") == "get_revenue"), star.products)

    first, last = month_range(F.year("date_max"), F.col("month"))
    this_month, month_before = month_of(F.col("date_max")), previous_month(F.col("date_max"))
    has_product = (F.col("intent") == "get_revenue") & F.col("product_name").isNotNull()
    tool = F.when(has_product | F.col("intent").isin(*fixed.TOOLS[1:]), F.col("intent"))
    arguments = (
        F.when(F.col("intent") == "get_data_quality", F.lit("{}"))
        .when(
            F.col("intent") == "compare_periods",
            _arguments(
                metric=F.lit("average_order_value"),
                current_start=iso(this_month),
                current_end=iso(F.last_day(this_month)),
                previous_start=iso(month_before),
                previous_end=iso(F.last_day(month_before)),
                filters=F.create_map().cast("map<string,string>"),
            ),
        )
        .when(
            F.col("intent") == "get_top_entities",
            _arguments(
                dimension=F.when(F.col("by_store"), "store_category").otherwise("product_category"),
                metric=F.lit("revenue"),
                start_date=iso(F.col("date_min")),
                end_date=iso(F.col("date_max")),
                limit=F.lit(1),
            ),
        )
        .when(
            has_product,
            _arguments(
                start_date=iso(F.coalesce(first, F.col("date_min"))),
                end_date=iso(F.coalesce(last, F.col("date_max"))),
                product_name=F.col("product_name"),
            ),
        )
    )
    return (
        rows.join(found, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            tool.alias("tool"),
            arguments.alias("arguments"),
            "intent",
            "problem",
        )
        .select(
            "conv_id",
            "turn",
            F.when(F.col("intent") == INVALID, INVALID)
            .when(F.col("tool").isNull(), UNSUPPORTED)
            .otherwise(PLANNED)
            .alias("status"),
            "tool",
            "arguments",
            F.when(F.col("intent") == INVALID, F.col("problem"))
            .when(F.col("intent") == "no_dates", fixed.NO_DATES_TEXT)
            .when(F.col("tool").isNull(), fixed.OUT_OF_SCOPE_TEXT)
            .alias("reason"),
        )
    )
