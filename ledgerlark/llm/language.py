"""Language identification by nearest centroids.

A text is the vector of its character n-grams, hashed to ``DIMENSIONS``
buckets, weighted by TF-IDF and normalised.  Document frequencies are counted
over all training texts.  The training texts of a language fall into several
clusters (spherical k-means), whose means are its centroids.  A text takes the
language of the centroid with the largest cosine; one that is farther from it
than nearly all of the cluster's own texts is rejected.

Only text decides a prediction.  Clusters are fitted on a bounded sample of
training texts, ``SAMPLE`` documents; all else reads all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import workers_see_package

#: Buckets of hashed n-grams, and the lengths of n-grams.
DIMENSIONS, LENGTHS = 1 << 14, (1, 2, 3, 4)
#: Centroids of a language, and rounds of clustering.
CENTROIDS, ROUNDS = 4, 8
#: About how many training documents of all languages clusters are fitted on (a language has SAMPLE_LEAST at least).
SAMPLE, SAMPLE_LEAST = 6000, 200
#: Share of a cluster's own texts that are farther from the centroid than its limit.
OUTSIDE = 0.01
#: What equal cosines may differ by.
ROUNDING = 1e-4
#: Languages that a model may have: bounds it, with the buckets and centroids, to 256 MB.
MAX_LANGUAGES = 1024
#: One document in so many is held out.
HELD_OUT = 5
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Code points at a time, so long texts take bounded memory; windows overlap by the longest n-gram.
WINDOW = 1 << 20
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], "<u4")


def bucket_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text; None if it has no letter.

    Letters are lower-cased, and what is between words becomes one space, which
    n-grams of two and more see.
    """
    plain = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not plain:
        return None
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for start in range(0, len(codes), WINDOW):
        part = codes[start : start + WINDOW + LENGTHS[-1] - 1]
        mixed = np.zeros(len(part), "<u4")
        for n in LENGTHS:
            # n-grams that start in this window
            k = min(len(codes) - start, WINDOW + n - 1) - n + 1
            if k <= 0:
                break
            mixed = (mixed[:k] ^ part[n - 1 : n - 1 + k]) * MIX[n % len(MIX)]
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount(((mixed * MIX[0]) >> shift).astype(np.int64), minlength=DIMENSIONS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    weights = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt(np.dot(weights, weights))
    return at.astype(np.int32), (weights / norm if norm else weights).astype(np.float32)


def clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of normalised rows: (normalised centroids, the least cosine of nearly all members).

    Starts from rows drawn by their distance from those already drawn; the same
    rows always give the same centroids.  Rows fewer than ``k``, or equal ones,
    give fewer centroids.
    """
    draw = np.random.default_rng(len(vectors))
    chosen = [int(draw.integers(len(vectors)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        far = np.clip(1 - nearest, 0, None).astype(np.float64)
        if far.sum() < 1e-6:
            break
        chosen.append(int(draw.choice(len(vectors), p=far / far.sum())))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    own = _normalised(vectors[chosen])
    for _ in range(ROUNDS):
        member = np.argmax(vectors @ own.T, axis=1)
        own = _normalised(np.array([vectors[member == i].sum(axis=0) for i in np.unique(member)]))
    cosines = vectors @ own.T
    member, best = np.argmax(cosines, axis=1), cosines.max(axis=1)
    limits = [np.quantile(best[member == i], OUTSIDE) - ROUNDING if (member == i).any() else 0.0 for i in range(len(own))]
    return own.astype(np.float32), np.array(limits, np.float32)


def _normalised(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


class Model:
    """Inverse document frequencies, and centroids with their languages and limits."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.limits = idf, languages, limits
        self.columns = np.ascontiguousarray(centroids.T)  # by bucket: a text reads its own buckets' rows

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, whether the text is farther than the centroid's limit)."""
        counts = bucket_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        at, weights = weighted(counts, self.idf)
        cosines = weights @ self.columns[at]
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.limits[best])


def training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang) of documents with a language that are not held out."""
    return docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )


def held_out(id_col: str):
    """Whether a document's identifier holds it out of training; a null one counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The IDF of every bucket, over all texts: each task counts its own, Spark adds them up."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = bucket_counts(text)
                if counts is not None:
                    found[:-1] += counts > 0
                    total += 1
        found[-1] = total
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": found[at]})

    rows = texts.select("text").mapInPandas(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequencies = np.zeros(DIMENSIONS + 1)
    for bucket, n in rows.collect():  # a row for each bucket at most
        frequencies[bucket] = n
    return np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1


def _sampled(texts: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the distinct ``texts``, by a hash of the text; small languages have more of theirs.

    Copies are one text, so a large group of them cannot fill the sample.
    """
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = max(SAMPLE_LEAST, sample // max(1, len(counts)))
    shares = texts.sparkSession.createDataFrame(
        [(lang, min(1.0, each / n)) for lang, n in counts.items()], "lang string, share double"
    )
    place = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return texts.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text").distinct()


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    centroids: int = CENTROIDS, sample: int = SAMPLE,
) -> Model:
    """The model of all training documents; each language's clusters are fitted by a task of its own."""
    workers_see_package(docs.sparkSession)
    texts = training(docs, id_col, text_col, lang_col)
    idf = inverse_frequencies(texts)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"]):
                if (counts := bucket_counts(text)) is not None:
                    rows.append((lang, zlib.crc32(text.encode("utf-8", "surrogatepass")), *weighted(counts, idf)))
            yield pd.DataFrame(rows, columns=["lang", "tie", "at", "weights"])

    def clustered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tie", kind="stable")
        dense = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (at, weights) in enumerate(zip(rows["at"], rows["weights"])):
            dense[i, at] = weights
        own, limits = clusters(dense, centroids)
        return pd.DataFrame({"lang": [key[0]] * len(own), "k": range(len(own)), "centroid": list(own), "least": limits})

    vectors = _sampled(texts, sample).mapInPandas(sparse, "lang string, tie long, at array<int>, weights array<float>")
    rows = (
        vectors.groupBy("lang")
        .applyInPandas(clustered, "lang string, k int, centroid array<float>, least float")
        .orderBy("lang", "k")
        .collect()
    )
    matrix = np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), DIMENSIONS)
    return Model(idf, [r["lang"] for r in rows], matrix, np.array([r["least"] for r in rows], np.float32))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    workers_see_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets, centroids and MAX_LANGUAGES

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [shared.value.predict(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "lang_pred": [x[0] for x in out],
                    "score": [x[1] for x in out],
                    "rejected": [x[2] for x in out],
                }
            )

    narrow = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    schema = "doc_id string, held_out boolean, lang_pred string, score double, rejected boolean"
    return narrow.mapInPandas(predict, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Learned from documents of ``docs`` that are not held out and have a
    language; predictions read the text only.  ``lang_pred`` is the nearest
    language, and ``rejected`` tells that the text is farther from it than the
    language's own; ``score`` is the cosine.  A text that is null or has no
    letter, or any text if there is nothing to learn from, is UNKNOWN with
    score 0 and rejected.  Repeated rows are rows of their own and count
    again; texts are read whole.  An empty table gives no rows.
    """
    return predicted(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
