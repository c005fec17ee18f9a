from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from ledgerlark.llm import language
from tests.llm.helpers import DOCS, awkward, empty

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_prediction_reads_text_only(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    model = language.fit(docs, sample=100)
    swapped = docs.selectExpr("doc_id", "text", "'xx' as lang", "'none' as source", "n_chars")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, model).collect()}
    assert plain == {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(swapped, model).collect()}


def test_counts_of_windows(monkeypatch):
    text = "Größe und l'été, 123 ... " * 50 + "\U0001f600 ça"
    whole = language.bucket_counts(text)
    plain = " größe und l été" + " größe und l été" * 49 + " ça "
    assert whole.sum() == sum(len(plain) - n + 1 for n in language.LENGTHS)
    monkeypatch.setattr(language, "WINDOW", 37)
    assert (language.bucket_counts(text) == whole).all()
    assert language.bucket_counts("a").sum() == 6
    for nothing in (None, "", " \n", "12 _ 3.4"):
        assert language.bucket_counts(nothing) is None


def test_frequencies_against_plain_counts(spark):
    texts = ["one two", "two three", "two", None, "", "7", "two"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    idf = language.inverse_frequencies(docs)
    found = Counter(b for t in texts if (c := language.bucket_counts(t)) is not None for b in np.flatnonzero(c))
    assert all(np.isclose(idf[b], np.log(5 / (1 + found[b])) + 1) for b in range(language.DIMENSIONS))


def test_rejection_clusters_and_copies(spark):
    rows = [(i, f"the cat number{i} sat on the mat and the dog ran", "en", "s", 1) for i in range(60)]
    rows += [(100 + i, f"der hund nummer{i} und die katze sind nicht da", "de", "s", 1) for i in range(60)]
    rows += [(300 + i, "the very same text", "en", "s", 1) for i in range(200)]
    rows += [(600, "ЖЖЖ ЩЩЩ ЮЮЮ", None, "s", 1), (601, "the dog and the cat", None, "s", 1), (602, "die katze", None, "s", 1)]
    out = {r.doc_id: r for r in language.languages(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[600].rejected and out[600].lang_pred in ("en", "de") and out[600].score < 0.05
    assert out[601].lang_pred == "en" and out[602].lang_pred == "de"
    assert not out[300].rejected
    centroids, limits = language.clusters(np.eye(6, dtype=np.float32).repeat(5, axis=0), 6)
    assert len(centroids) == 6 and (limits > 0.9).all()


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    for name in ("lang_pred", "score", "held_out", "share", "bucket"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    rows = language.languages(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in rows if r.doc_id in (1, 3, 4, 5, 6, 8))
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.languages(unlabelled).collect()} == {"und"}
    assert language.languages(empty(spark)).count() == 0
