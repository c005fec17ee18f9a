"""Groups of spelling variants by permuterm rotations.

A word is marked with a terminator and turned: for each place i, the text after
i, the terminator, and the text before i.  With the character at i behind it,
this is a rotation of the word; without it, it is the prefix that the rotations
of all words share which have another character at i, and the whole rotation of
the word that lacks it.  So sorted by that key, replacements and indels of a
place stand side by side, and a scan of each group emits every word's
neighbours in it as a count and the best one, never as pairs.

A key leaves one character open, so a group has at most one word for each
character of the alphabet and one that is a character shorter.  Words go by
their numbers in code-point order.  All rotations of a word take the square of
its length, so those of very long words go by digests, which follow from
digests of the word's beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import numbered, stored, workers_see_package

#: Maximal runs of these characters are words; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts below every character of a word and is none.
END = "$"
#: One run in so many, by its checksum, loses a character.
DAMAGED = 97
#: Code points and occurrences that a word has at least.
MIN_LENGTH, MIN_COUNT = 5, 3
#: Code points from which on rotations go by digests, and how many of those a worker hands back at a time.
LONG, PIECE = 64, 1 << 16
#: Odd multipliers of the digests.
MIX, BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: A form occurs so many times as often as its variant.
MIN_RATIO = 2


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of whole texts that are long and frequent enough.

    A run whose checksum with its document's identifier DAMAGED divides loses
    one character, so the corpus has spelling variants to find.  Occurrences
    are counted before they are shuffled.  A null identifier is the empty text.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    checksum = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    n = F.length("run")
    at = (F.col("checksum") % n).cast("int")
    damaged = F.concat(F.left("run", at), F.substr("run", at + 2))
    word = F.when(F.col("checksum") % DAMAGED == 0, damaged).otherwise(F.col("run"))
    return (
        runs.where(n >= MIN_LENGTH)
        .withColumn("checksum", checksum)
        .select(word.alias("word"))
        .where(F.length("word") >= MIN_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_COUNT)
    )


def rotations(counted: DataFrame) -> DataFrame:
    """(key, id, n, whole, first) of all rotations of words (id, word, n).

    ``whole``: the key is the whole rotation; else it lacks the last character,
    which is the edited one.  ``first``: that character differs from the one
    before it, so of equal ways to delete a character only one counts.  Keys
    that LONG words could have are digests.
    """
    at, n = F.col("at"), F.length("word")
    turned = F.concat(F.substr("word", at + 1), F.lit(END), F.left("word", at))
    whole = counted.where(n < LONG).select("id", "word", "n", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    places = counted.where(n <= LONG).select("id", "word", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    skipped = F.concat(F.substr("word", at + 2), F.lit(END), F.left("word", at))
    first = (at == 0) | (F.substr("word", at + 1, F.lit(1)) != F.substr("word", F.greatest(at, F.lit(1)), F.lit(1)))

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, word, count in zip(batch["id"], batch["word"], batch["n"]):
                for keys, is_whole, firsts in digests(word):
                    yield pd.DataFrame({"key": keys, "id": number, "n": count, "whole": is_whole, "first": firsts})

    long = counted.where(n >= LONG).select("id", "word", "n")
    return (
        whole.select(turned.alias("key"), "id", "n", F.lit(True).alias("whole"), F.lit(False).alias("first"))
        .unionByName(places.select(skipped.alias("key"), "id", "n", F.lit(False).alias("whole"), first.alias("first")))
        .unionByName(long.mapInPandas(digested, "key string, id long, n long, whole boolean, first boolean"))
    )


def digests(word: str) -> Iterator[tuple[list[str], bool, np.ndarray | bool]]:
    """(keys, whole, first) of a long word: digests of its rotations, without the last character and whole.

    Polynomials over the characters modulo 2**64 in two bases; the digest of
    any part follows from those of the beginnings, so a key takes no time of
    its own, and keys come in pieces.
    """
    marked = np.frombuffer((word + END).encode("utf-32-le"), "<u4").astype(np.uint64) * np.uint64(MIX) + np.uint64(1)
    codes, end = marked[:-1], marked[-1]
    n = len(codes)
    firsts = np.append(True, codes[1:] != codes[:-1])
    with np.errstate(over="ignore"):
        lanes = []
        for base in BASES:
            powers = np.cumprod(np.append(np.uint64(1), np.full(n + 1, base, np.uint64)), dtype=np.uint64)
            back = np.full(n, pow(base, -1, 2**64), np.uint64)
            begun = np.append(np.uint64(0), np.cumsum(codes * np.cumprod(back, dtype=np.uint64), dtype=np.uint64)) * powers[: n + 1]
            lanes.append((powers, begun))
        for whole in (False, True):
            if not whole and n == LONG:  # it has a key as text
                continue
            for start in range(0, n + whole, PIECE):
                at = np.arange(start, min(n + whole, start + PIECE))
                after = at if whole else at + 1
                keys = []
                for powers, begun in lanes:
                    rest = begun[n] - begun[after] * powers[n - after]
                    keys.append((rest * powers[1] + end) * powers[at] + begun[at])
                length = n + 1 if whole else n
                yield [f"{length}:{x}:{y}" for x, y in zip(*(k.tolist() for k in keys))], whole, False if whole else firsts[at]


def _near(x: Column, y: Column) -> Column:
    """Whether members x and y of a group are near and counted here."""
    return F.when(x["whole"], y["first"]).when(y["whole"], x["first"]).otherwise(x["id"] != y["id"])


def neighbours(counted: DataFrame) -> DataFrame:
    """(id, n_near, best) of all words with near words; ``best`` is (less: -n, id) of the most frequent one.

    A scan of the sorted rotations; words alone in their group emit nothing.
    """
    member = F.struct((-F.col("n")).alias("less"), "id", "whole", "first").alias("x")
    group = Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.get("near", F.lit(0))
    return (
        rotations(counted)
        .select("key", member)
        .withColumn("members", F.collect_list("x").over(group))
        .where(F.size("members") > 1)
        .withColumn("near", F.filter("members", lambda y: _near(F.col("x"), y)))
        .where(F.size("near") > 0)
        .select(
            F.col("x.id").alias("id"),
            F.size("near").alias("n_near"),
            F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("best"),
        )
        .groupBy("id")
        .agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    )


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` (id, form_id) with ``root_id``: the last word along the forms.

    Every word's pointer jumps to its target's pointer in each round.  A form
    is at least MIN_RATIO times as frequent as its variant, so chains are as
    long as the logarithm of the largest count, and the rounds no more than
    the logarithm of that, and one.
    """
    pointers = stored(formed.where("form_id is not null").select("id", F.col("form_id").alias("root_id")), "variant-pointers")
    while True:
        onward = pointers.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        jumped = stored(pointers.join(onward, "root_id", "left"), "variant-jumps")
        if not jumped.where("next is not null").take(1):
            break
        pointers = jumped.select("id", F.coalesce("next", "root_id").alias("root_id"))
    return formed.join(pointers, "id", "left").withColumn("root_id", F.coalesce("root_id", "id"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (ties: the first by code points),
    if it is at least MIN_RATIO times as frequent as the word; else null.
    Null and empty texts have no words; repeated rows count again; a very long
    text is read whole.  An empty table gives no rows.
    """
    workers_see_package(docs.sparkSession)
    counted = stored(numbered(words(docs, id_col, text_col), ["word"], "id"), "variant-words")
    form = (-F.col("best.less")) >= MIN_RATIO * F.col("n")
    formed = counted.drop("word").join(neighbours(counted), "id", "left").select(
        "id",
        F.when(form, F.col("best.id")).alias("form_id"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, -F.col("best.less")).alias("form_n"),
    )
    out = rooted(stored(formed, "variant-forms"))
    for name in ("", "form_", "root_"):
        named = counted.select(F.col("id").alias(f"{name}id"), F.col("word").alias(name.strip("_") or "word"))
        out = out.join(named, f"{name}id", "left")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
