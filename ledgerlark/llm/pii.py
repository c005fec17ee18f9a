"""Personal data: fixed formats, and what stands where such data usually stands.

Base spans match fixed formats.  One to three words before them, and the word
before with the word after, are lexical patterns, and patterns and the identifiers they extract form a graph that Spark scores in
rounds: a pattern's score is the share of its kind among the known identifiers
it has met, times a term that grows with their number; candidates not known yet
count neither way.  An identifier's score is one minus the product of the
doubts of its patterns.  Identifiers above the limit are known in the next
round, wherever they stand, until a round adds none.  "the" is followed by
anything, mostly by no candidate at all, so it extracts nothing; "phone:" may
extract numbers that no fixed format covers.

All of it is built-in expressions, joins and windows.  Rows exist for matches
only; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, apart, located, small_side, stored

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")

#: Patterns of the contract.  Repetitions are possessive, and runs start at their first
#: character (or after the match before), so long runs take linear time and no stack.
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
FORMATS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier perhaps: an account number in groups of four, digits in groups (each too short
#: to be a number of its own), or a token with enough digits or an at sign.
SOLID, ENDING = r"[^\x20\x09-\x0D]", r"""(?=[)"'>\]},.;:!?]*+(?:[\x20\x09-\x0D]|\z))"""
PIECE = rf"(?!(?:[^0-9\x20\x09-\x0D]*+[0-9]){{9}})(?=[(\[]?[0-9])[0-9()\[\]/-]++{ENDING}"
CANDIDATE = (
    rf"(?<!{SOLID})(?:"
    rf"""["'<{{(\[]*+[A-Z]{{2}}[0-9]{{2}}(?:\x20[A-Z0-9]{{4}}(?![A-Za-z0-9])){{2,7}}+(?:\x20[A-Z0-9]{{1,3}}{ENDING})?+{ENDING}"""
    rf"""|(?=(?:[^0-9A-Za-z]*+[0-9]){{{4}}})["'<{{]*+\+?+{PIECE}(?:\x20{PIECE}){{1,9}}+"""
    rf"|(?={SOLID}{{6}})(?=(?:[^0-9\x20\x09-\x0D]*+[0-9]){{{4}}}|[^@\x20\x09-\x0D]*+@){SOLID}++"
    r")"
)
#: Quotes and brackets before an identifier; a bracket closed within it, before a digit, belongs to it.
OPENING = r"""^(?:["'<{]|\((?![^()]*\)[^()]*[0-9])|\[(?![^\[\]]*\][^\[\]]*[0-9]))+"""
CLOSING = r"""[)"'>\]},.;:!?]+$"""
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: An identifier has so many characters, and so many digits or an at sign.
MIN_LENGTH, MIN_DIGITS = 6, 4
#: Code points before and after a match in which the words of its patterns are looked for first.
CONTEXT = 80
#: Words of a pattern at most.
PATTERN_WORDS = 3
#: Different known identifiers that a pattern must have met.
MIN_SUPPORT = 3
#: Share of a pattern's occurrences that some candidate, known or not, must follow.
MIN_SHARE = 0.25
#: Scores that make a pattern, and an identifier, trusted.
MIN_PATTERN, MIN_IDENTIFIER = 0.5, 0.5


def _words(text: Column) -> Column:
    """Hashes of the lower-case words of a text."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def _words_before(piece: Column) -> Column:
    """Hashes of the last words of what is before a match, PATTERN_WORDS at least if there are so many.

    The edge of CONTEXT may cut a word, so the first one there does not count;
    only where too few remain is the whole piece read.
    """
    near = _words(F.substr(piece, F.lit(-CONTEXT)))
    return (
        F.when(F.length(piece) <= CONTEXT, near)
        .when(F.size(near) > PATTERN_WORDS, F.slice(near, F.lit(2), F.size(near)))
        .otherwise(_words(piece))
    )


def _word_after(piece: Column) -> Column:
    """Hash of the first word of what is after a match."""
    near = _words(F.left(piece, F.lit(CONTEXT)))
    whole = (F.length(piece) <= CONTEXT) | (F.size(near) > 1)
    return F.when(whole, F.get(near, F.lit(0))).otherwise(F.get(_words(piece), F.lit(0)))


def _patterns(words: Column, right: Column) -> Column:
    """Hashes of the last one, two and three of ``words``, and of the last one with the word ``right``."""
    last = [F.get(words, F.size(words) - k) for k in (1, 2, 3)]
    kinds = [
        F.when(F.size(words) >= k, F.xxhash64(F.lit(k), *last[:k])) for k in (1, 2, 3)
    ] + [F.when((F.size(words) >= 1) & right.isNotNull(), F.xxhash64(F.lit(0), last[0], right))]
    return F.array_compact(F.array(*kinds))


def _met_patterns(texts: DataFrame, text: str) -> DataFrame:
    """(h) of ``_patterns`` at every word: one, two and three words, and two with one between."""
    none = F.lit(None).cast("long")
    shifted = F.arrays_zip(
        F.col("words").alias("w"),
        F.concat(F.array(none), "words").alias("one"),
        F.concat(F.array(none, none), "words").alias("two"),
    )
    at = (
        texts.select(_words(F.col(text)).alias("words"))
        .select(F.explode(shifted).alias("x"))
        .select("x.w", "x.one", "x.two")
        .where("w is not null")
    )
    hashes = F.array(
        F.xxhash64(F.lit(1), "w"),
        F.when(F.col("one").isNotNull(), F.xxhash64(F.lit(2), "w", "one")),
        F.when(F.col("two").isNotNull(), F.xxhash64(F.lit(3), "w", "one", "two")),
        F.when(F.col("two").isNotNull(), F.xxhash64(F.lit(0), "two", "w")),
    )
    return at.select(F.explode(hashes).alias("h"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    backwards = F.reverse(digits)

    def weighed(i: Column) -> Column:
        digit = F.substr(backwards, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = digits_of(value)
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def fits(kind: Column, value: Column) -> Column:
    """Whether a discovered value may be of a kind by its shape.

    An e-mail address has an at sign and the others have none; what has the
    format of a kind but failed its check is not of that kind.
    """
    address = value.contains("@")
    failed = F.coalesce(*[F.when(kind == name, value.rlike(f"^(?:{FORMATS[name]})$")) for name in KINDS[1:]])
    return F.when(kind == "email", address).otherwise(~address & ~failed)


def matches(rows: DataFrame, text: str) -> DataFrame:
    """(place, kind, start, end, value, patterns, direct) of all format matches and candidates of ``rows``.

    ``patterns`` are hashes of the words around; where only blanks part a match
    from the one before, it takes that one's, and is not ``direct``.  A split by a pattern and its matches alternate, so lengths give positions
    (code points) as running sums.  Rows: one for each match.
    """

    def found(kind: str, pattern: str, clue: str) -> Column:
        some = F.col(text).contains(clue) if len(clue) == 1 else F.col(text).rlike(clue)
        return F.when(
            some & F.col(text).rlike(pattern),
            F.struct(
                F.lit(kind).alias("kind"),
                F.arrays_zip(
                    F.split(F.col(text), pattern).alias("piece"),
                    F.slice(F.split(F.col(text), pattern), 2, F.size(F.split(F.col(text), pattern))).alias("after"),
                    F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("value"),
                ).alias("parts"),
            ),
        )

    clues = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "+"}
    every = [found(kind, FORMATS[kind], clues[kind]) for kind in KINDS]
    every.append(found("candidate", CANDIDATE, "[0-9@]"))
    parts = (
        rows.where(F.col(text).rlike("[0-9@]"))
        .select(*PLACE, F.explode(F.array_compact(F.array(*every))).alias("found"))
        .select(*PLACE, "found.kind", F.posexplode("found.parts").alias("k", "part"))
        .where("part.value is not null")
        .select(
            *PLACE,
            "kind",
            "k",
            F.length("part.piece").alias("before"),
            F.col("part.value").alias("value"),
            ((F.col("k") == 0) | F.col("part.piece").rlike(r"[^\x20\x09-\x0D]")).alias("direct"),
            _words_before(F.col("part.piece")).alias("_left"),
            _word_after(F.col("part.after")).alias("_right"),
        )
        .withColumn("_own", F.when(F.col("direct"), _patterns(F.col("_left"), F.col("_right"))))
    )
    so_far = Window.partitionBy(*PLACE, "kind").orderBy("k")
    placed = parts.withColumn("end", F.sum(F.col("before") + F.length("value")).over(so_far)).withColumn(
        "start", F.col("end") - F.length("value")
    )
    placed = placed.withColumn("patterns", F.last("_own", ignorenulls=True).over(so_far))
    core = F.regexp_replace(F.regexp_replace("value", OPENING, ""), CLOSING, "")
    lead = F.length("value") - F.length(F.regexp_replace("value", OPENING, ""))
    is_candidate = F.col("kind") == "candidate"
    trimmed = (
        placed.withColumn("_lead", F.when(is_candidate, lead).otherwise(0))
        .withColumn("value", F.when(is_candidate, core).otherwise(F.col("value")))
        .withColumn("start", F.col("start") + F.col("_lead"))
        .withColumn("end", F.when(is_candidate, F.col("start") + F.length("value")).otherwise(F.col("end")))
    )
    identifier = (F.length("value") >= MIN_LENGTH) & (
        F.col("value").contains("@") | (F.length(digits_of(F.col("value"))) >= MIN_DIGITS)
    )
    return trimmed.where(F.when(is_candidate, identifier).otherwise(_valid(F.col("kind"), F.col("value")))).select(
        *PLACE, "kind", "start", "end", "value", "patterns", "direct"
    )


def outside_base(found: DataFrame) -> DataFrame:
    """``found`` without candidates that overlap a base span: two running limits per text."""
    base = F.col("kind") != "candidate"
    by_start = Window.partitionBy(*PLACE).orderBy("start", "end", "kind")
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    later = by_start.rowsBetween(1, Window.unboundedFollowing)
    return (
        found.withColumn("_reached", F.max(F.when(base, F.col("end"))).over(earlier))
        .withColumn("_next", F.min(F.when(base, F.col("start"))).over(later))
        .where(
            base
            | (
                (F.coalesce("_reached", F.lit(0)) <= F.col("start"))
                & (F.coalesce("_next", F.col("end")) >= F.col("end"))
            )
        )
        .drop("_reached", "_next")
    )


@contextmanager
def run_time_filter(spark: SparkSession) -> Iterator[None]:
    """Joins planned in here may filter a large side by a Bloom filter of the other one.

    Where patterns are too many to broadcast, all words of the corpus would be
    shuffled to meet them.  Spark then builds a filter of at most 8 MB (a few
    per cent of false positives at four million patterns), sends it to the
    scan of the words, and joins exactly what is left.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "4g")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discovered(found: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(value, kind) of identifiers that trusted patterns extract from ``found``'s candidates.

    Edges (pattern, value) are counted once, so copies weigh as counts and no
    hot pattern or value is a large group.  ``texts`` gives the occurrences of
    each pattern in the whole corpus.  Only values that stand directly behind
    a pattern are evidence for its kind, not those that a row of values has
    handed it on to; and a pattern extracts what has the shape of its kind.

    Each round but the last adds an identifier, and a chain of patterns and
    identifiers is as long as the rounds, so their number is bounded by the
    longest shortest path of the graph.  Rounds are written.
    """
    edges = stored(
        found.select(F.explode("patterns").alias("h"), "value", "kind", "direct")
        .groupBy("h", "value")
        .agg(
            F.count_if("direct").alias("n"),
            F.min(F.when(F.col("kind") != "candidate", F.col("kind"))).alias("kind"),
        ),
        "pattern-edges",
    )
    seeds = found.where("kind <> 'candidate'").groupBy("value").agg(F.min("kind").alias("kind"))
    known = seeds.withColumn("score", F.lit(1.0))
    # to discover a value, a pattern has met MIN_SUPPORT others, whichever round makes them known
    useful = (
        edges.groupBy("h")
        .agg(
            F.count(F.lit(1)).alias("values"),
            F.count_if(F.col("kind").isNull()).alias("open"),
            F.sum("n").alias("met"),
        )
        .where((F.col("values") > MIN_SUPPORT) & (F.col("open") > 0))
        .select("h", "met")
    )
    useful = stored(useful, "patterns")
    if not useful.take(1):
        return seeds.where("false")
    with run_time_filter(texts.sparkSession):
        occurrences = stored(
            _met_patterns(texts, text)
            .join(small_side(useful.select("h"), 8), "h", "left_semi")
            .groupBy("h")
            .agg(F.count(F.lit(1)).alias("occurrences")),
            "pattern-occurrences",
        )
    # right words behind several tokens are not met two words on: such patterns have no count
    telling = (
        useful.join(occurrences, "h", "left")
        .where(F.col("met") >= MIN_SHARE * F.coalesce("occurrences", F.lit(0)))
        .select("h")
    )
    direct = (F.col("n") > 0).alias("direct")
    graph = stored(edges.select("h", "value", direct).join(telling, "h"), "pattern-graph")
    new = seeds.where("false").withColumn("score", F.lit(1.0))
    while True:
        patterns = (
            graph.where("direct")
            .join(known, "value")
            .groupBy("h", "kind")
            .agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("support"))
            .groupBy("h")
            .agg(F.sum("weight").alias("all"), F.max(F.struct("weight", "kind", "support")).alias("of"))
            .withColumn("trust", F.col("of.weight") / F.col("all") * F.col("of.weight") / (F.col("of.weight") + 1))
            .where((F.col("of.support") >= MIN_SUPPORT) & (F.col("trust") >= MIN_PATTERN))
            .select("h", F.struct("trust", "of.kind").alias("best"))
        )
        scored = (
            graph.join(patterns, "h")
            .where(fits(F.col("best.kind"), F.col("value")))
            .join(known.select("value"), "value", "left_anti")
            .groupBy("value")
            .agg(
                F.max_by("best.kind", "best.trust").alias("kind"),
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("best.trust"), F.lit(1e-9)))))).alias("score"),
            )
            .where(F.col("score") >= MIN_IDENTIFIER)
        )
        fresh = stored(scored, "identifiers")
        if not fresh.take(1):
            return new.select("value", "kind")
        new = stored(new.unionByName(fresh), "known-identifiers")
        known = seeds.withColumn("score", F.lit(1.0)).unionByName(new)


def spans(docs: DataFrame, text_col: str = "text", learn: bool = True) -> DataFrame:
    """(place, kind, start, end, base) of all personal data in whole texts of ``docs``.

    Positions are code points, ``end`` exclusive.  Null and empty texts have
    none.  Base spans are leftmost and do not overlap others of their kind;
    matches that fail their check are dropped without another try.  Spans of
    different kinds may overlap.  ``learn`` adds discovered identifiers.
    """
    texts = located(docs).select(*PLACE, F.col(text_col).alias("text"))
    found = stored(matches(texts, "text"), "pii-matches")
    base = found.where("kind <> 'candidate'").select(*PLACE, "kind", "start", "end", F.lit(True).alias("base"))
    if not learn:
        return base
    outside = stored(outside_base(found), "pii-slots")
    new = stored(discovered(outside, texts, "text"), "pii-discovered")
    extra = (
        outside.where("kind = 'candidate'")
        .drop("kind")
        .join(small_side(new, F.length("value") + 16), "value")
        .select(*PLACE, "kind", "start", "end", F.lit(False).alias("base"))
    )
    return base.unionByName(extra)


def _listed(entries: Column) -> Column:
    order = F.array_sort(entries)
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(
        F.transform(order, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


@apart
def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The counts and the hash are of base spans; ``spans`` lists all, and
    ``n_found`` counts those that patterns discovered.  A text without any
    (null and empty ones too) has zeros, the hash of no bytes, and ''.
    Repeated rows are rows of their own.  An empty table gives no rows.
    """
    rows = located(docs)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    all_spans = stored(spans(rows, text_col), "pii-spans").withColumn(
        "entry", F.struct("start", number.alias("kind"), "end")
    )
    per_doc = all_spans.groupBy(*PLACE).agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        F.count_if(~F.col("base")).alias("n_found"),
        F.collect_list(F.when(F.col("base"), F.col("entry"))).alias("_base"),
        F.collect_list("entry").alias("_all"),
    )
    listed = per_doc.withColumn("_base", _listed(F.col("_base"))).withColumn("_all", _listed(F.col("_all")))
    counts = [*[f"n_{kind}" for kind in KINDS], "n_found"]
    return (
        rows.select(*PLACE, F.col(id_col).alias("doc_id"))
        .join(listed, PLACE, "left")
        .select(
            "doc_id",
            *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts],
            F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("_all", F.lit("")).alias("spans"),
        )
    )


#: Code points of a block: a text is cut into blocks once, and positions are reached by their block.
BLOCK = 512


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points ``start`` to ``end`` (exclusive) of a text cut into ``blocks``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    tail, head = start % BLOCK, end % BLOCK
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substr(block(first), tail + 1, head - tail)).otherwise(
        F.concat(F.substr(block(first), tail + 1, F.lit(BLOCK)), inner, F.left(block(last), head))
    )


@apart
def masked(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind, as ``[EMAIL]``; overlapping ones by the first.

    Only rows with personal data are joined; others, and other columns, stay
    as they are; ``length_col`` follows the text.  A text is cut into blocks
    once, so its cost is its length and a block for each span.
    """
    rows = located(docs)
    by_start = Window.partitionBy(*PLACE).orderBy("start", "end", "kind")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans(rows, text_col)
        .withColumn("_new", (F.coalesce(reached, F.lit(-1)) <= F.col("start")).cast("int"))
        .withColumn("_group", F.sum("_new").over(by_start))
        .groupBy(*PLACE, "_group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
        .withColumns({name: F.col(name).cast("int") for name in ("start", "end")})
        .groupBy(*PLACE)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
        .withColumn("_cuts", F.transform(
            "_cuts",
            lambda x, i: F.struct(
                F.when(i > 0, F.get(F.col("_cuts"), F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0).alias("after"),
                x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"),
            ),
        ))
    )
    merged = small_side(stored(merged, "pii-cuts"), F.size("_cuts") * 40 + 40)
    joined = rows.join(merged, PLACE, "left")
    text = F.col(text_col)
    blocks = F.when(F.col("_cuts").isNotNull(), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    joined = joined.withColumn("_blocks", blocks)

    def until(x: Column) -> Column:
        return F.concat(_between(F.col("_blocks"), x["after"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))

    end = F.element_at("_cuts", -1)["end"]
    whole = (F.size("_blocks") * BLOCK).cast("int")
    rest = _between(F.col("_blocks"), end, whole)
    touched = F.col("_cuts").isNotNull()
    out = joined.withColumn(
        "_masked", F.when(touched, F.concat(F.array_join(F.transform("_cuts", lambda x: until(x)), ""), rest)).otherwise(text)
    )
    columns = [F.col("_masked").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        at = docs.columns.index(length_col)
        columns[at] = (
            F.when(touched, F.length("_masked").cast(kind)).otherwise(F.col(length_col)).alias(length_col)
        )
    return out.select(*columns)
