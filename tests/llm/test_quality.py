from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerlark.llm import quality
from tests.llm.helpers import DOCS, awkward, empty


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_against_plain_python(spark):
    docs = awkward(spark).where("length(text) < 1000 or text is null").select("doc_id", "text", "lang", "source", "n_chars")
    texts = ["a b c d e a b c d e a b c d e", "a a a a a a a", "x y z # $$ <b>\nx y z # $$ <b>\n \nq",
             "1 2 3 4 5 6 1 2 3 4 5 7 8 9 0 1 2 3 4 5", "\x0b\x0cq\rr s\tt"]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "z", 1) for i, t in enumerate(texts)], DOCS))
    rows = quality.counts_within(docs, "text").select("text", *FIELDS).collect()
    for row in rows:
        assert tuple(row[1:]) == plain_counts(row.text), row.text


def body(i, n=40):
    return " ".join(f"w{(i * 7919 + k * k * 31) % 9973}x{i}" for k in range(n))


def boilerplate_docs(spark):
    rows = [(i, f"Share 1{i % 10} this page\n{body(i)}\nall rights reserved", "en", "h", 0) for i in range(60)]
    rows += [(100 + i, "Share 99 this page\nall rights reserved here and there\nall rights reserved", "en", "h", 0) for i in range(2)]
    rows += [(200, "Share 55 this page\nshort own text\nall rights reserved\nall rights reserved\nand ten words or more of it stay", "en", "other", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark, tmp_path):
    docs = boilerplate_docs(spark)
    rows = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(rows[i].kept and rows[i].n_removed_words == 7 for i in range(60))
    assert not rows[100].kept and not rows[100].base_failed
    assert rows[200].n_removed_words == 0
    left = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert left[5].text == body(5) and left[5].n_chars == len(body(5))
    assert set(left) == {i for i in rows if rows[i].kept}


def test_copies_do_not_reject_each_other(spark):
    """Groups of exact and of near copies stay, though their lines are met often."""
    same = "\n".join(body(1000 + k, 12) for k in range(6))
    rows = [(i, same, "en", "h", 0) for i in range(80)]
    for i in range(80):
        lines = [body(2000 + k, 12) for k in range(6)]
        lines[i % 6] += f" edit{i}"
        rows.append((100 + i, "\n".join(lines), "en", "h", 0))
    judged = quality.judged(spark.createDataFrame(rows, DOCS))
    assert judged.where("not kept").count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert quality.quality(docs).count() == docs.count()
    assert quality.clean(docs).columns == docs.columns
    assert quality.quality(docs).where("kept").select(F.min("n_words")).first()[0] >= 10


def test_empty(spark):
    assert quality.quality(empty(spark)).count() == 0
    assert quality.clean(empty(spark)).count() == 0


def test_blocks_of_lines_go_whole(spark):
    """A footer of three lines, also in a host of 20 documents, which a short line opens."""
    footer = "Read more stories\nterms\nall rights reserved by us"
    rows = [(i, f"{body(i)}\n{body(500 + i)}\n{footer}", "en", "h", 0) for i in range(20)]
    rows += [(100 + i, f"{footer}\n{body(100 + i)}", "en", "g", 0) for i in range(12)]
    rows += [(200 + i, f"{footer}\n{body(200 + i)}", "en", "few", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS)
    removed = {r.doc_id: r.n_removed_words for r in quality.judged(docs).collect()}
    assert {removed[i] for i in range(20)} == {9} and {removed[100 + i] for i in range(12)} == {9}
    assert {removed[200 + i] for i in range(9)} == {0}
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert left[3] == f"{body(3)}\n{body(503)}" and left[103] == body(103)


def test_the_limit_follows_the_host(spark):
    """The same rows as one host and as ten: the footer goes either way, lines that few share stay."""
    def text(i):
        shared = f"a line that few documents share {i % 150}"
        return f"{body(i)}\n{shared}\n{body(5000 + i)}\nall rights are reserved"
    for hosts in (1, 10):
        rows = [(i, text(i), "en", f"h{i % hosts}", 0) for i in range(1500)]
        judged = quality.judged(spark.createDataFrame(rows, DOCS)).collect()
        assert {r.n_removed_words for r in judged} == {4} and all(r.kept for r in judged)


def test_clashing_columns(spark):
    docs = boilerplate_docs(spark)
    names = ("_removed", "_kept", "_t", "_row_file", "_row_place", "_words", "`a.b`")
    clashing = docs.selectExpr("*", *(f"doc_id as {name}" for name in names))
    out = quality.clean(clashing)
    assert out.columns == clashing.columns and out.count() == quality.clean(docs).count()
    assert all(r["_removed"] == r["a.b"] == r.doc_id for r in out.collect())
    assert quality.quality(clashing).count() == docs.count()
