from __future__ import annotations

import html
import re

import pytest

from ledgerlark.llm import extraction

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(("source", "text"), [
    ("<article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</article><footer>x</footer>", "A & B\n\none two\n\nthree four"),
    ("<nav><ul><li>Home<li>About</ul></nav><main><p>Text &lt;b&gt; &eacute;&nbsp;x</p><aside>no</aside></main>", "Text <b> é x"),
    ("<article><p>a</p><div class='ad-box'>buy<div>more</div></div><p>b</p><section id=comments><p>c</p></section></article>", "a\n\nb"),
    ("<article><p>a<script>var x='</article><p>';</script>b</p><style>p{}</style><!-- <p>c</p> --><form><p>d</p></form></article>", "ab"),
    ("<p title='>'>a</p ><P hidden>b</P><div style='display: none'>c</div>d", "a\n\nd"),
    ("<ul><li>one<li>two <i>x</i></ul>", "one\n\ntwo x"),
    ("", ""), ("<", "<"), ("a < b <3 </p>", "a < b <3"), ("<script>never ended", ""), ("<!-- never ended", ""),
    ("<article><header><h1>T</h1></header><p>x &am &amp y</p></article>", "T\n\nx &am & y"),
    ("<body class='no-ads'><p>x</p></body>", "x"),
    ("<article class=comment><p>c</p></article><p>main</p>", "main"),
    ("<p>" + "<b>" * 5000 + "deep", "deep"),
])
def test_pages_alone(source, text):
    assert extraction.unique_text(extraction.page_blocks(source), []) == text


@pytest.mark.parametrize("source, text", [
    ("<article><p>a <svg viewBox='0 0 1 1'/> b</p><p>c</p><svg><text>x</text></svg></article>", "a b\n\nc"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"),
    ("<article class='post comments-open'><p>own</p><div class=comments>no</div></article>", "own"),
    ("<div class='has-sidebar no-sidebar'><p>menu</p><article><p>own</p></article></div>", "own"),
    ("<form><nav>menu</nav><article><p>own</p></article></form>", "own"),
    ("<main><p>a long enough text</p><ol class=comments><article>re</article></ol></main>", "a long enough text"),
    ("<aside><article>see</article></aside><article>own</article>", "own"),
])
def test_articles_in_ordinary_markup(source, text):
    assert extraction.unique_text(extraction.page_blocks(source), []) == text


def test_repeated_runs_are_removed(spark):
    """Against all substrings of all pairs of pages."""
    notice = "<div>We use small files to make this site work well</div>"
    rows = [(i, "http://www.h.org/%d" % i, f"{notice}<p>own words number{i} of page{i} are here</p><p>Share</p>") for i in range(5)]
    rows += [(10, "http://other.org/1", f"{notice}<p>other host keeps it</p><p>Share</p>")]
    rows += [(11, "http://h.org/x", f"<article><p>We use small files to make this site work well</p></article>{notice}")]
    rows += [(12, None, None), (None, None, "<p>x</p>"), (13, "http://h.org/b", "<p>new We use small files to make this site work well end</p>"),
             (13, "http://h.org/b", "<p>new We use small files to make this site work well end</p>"), (14, "http://[bad", "<p>y</p>")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "1 as n", "2 as host")
    out = sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extracted(frame).collect())
    want = [(i, f"own words number{i} of page{i} are here") for i in range(5)]
    want += [(10, "We use small files to make this site work well\n\nother host keeps it\n\nShare"),
             (11, "We use small files to make this site work well"), (12, ""), (0, "x"), (13, "new end"), (13, "new end"), (14, "y")]
    assert out == sorted((i, t, len(t)) for i, t in want)


def test_suffixes_find_every_long_repeat():
    import random

    pick = random.Random(4)
    pages = [[pick.choice("abc") for _ in range(40)] for _ in range(4)]
    size = extraction.RUN_TOKENS
    met = {}
    for i, page in enumerate(pages):
        for start, n, h in extraction.suffixes([(" ".join(page), extraction.OPEN)]):
            met.setdefault(h, set()).add(i)
    for i, page in enumerate(pages):
        got = {k for start, n, h in extraction.suffixes([(" ".join(page), extraction.OPEN)]) if len(met[h]) > 1 for k in range(start, start + n)}
        want = set()
        for a in range(len(page)):
            for b in range(a + size, len(page) + 1):
                run = " ".join(page[a:b])
                if any(f" {run} " in f" {' '.join(other)} " for j, other in enumerate(pages) if j != i):
                    want |= set(range(a, b))
        assert got == want


def test_given_pages(spark):
    """The articles of the test pages, cut out by other means."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for row in extraction.extracted(pages).collect():
        article = re.search("<article>(.*?)</article>", sources[row.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in parts]
        assert row.text == "\n\n".join(part for part in plain if part)


def test_empty(spark):
    assert extraction.extracted(spark.createDataFrame([], PAGES)).count() == 0


def words(i: int, n: int = 30) -> str:
    return " ".join(f"w{i}x{k}" for k in range(n))


def plain_notices(articles: list[list[str]]) -> list[str]:
    """Texts of the articles of one host, from the rule, by comparing all blocks of all articles."""
    distinct = {tuple(article) for article in articles}
    out = []
    for article in articles:
        gone = []
        for block in article:
            having = sum(block in other for other in distinct)
            if len(block.split()) >= extraction.RUN_TOKENS and having >= extraction.NOTICE_ARTICLES and 2 * having > len(distinct):
                gone.append(block)
        lost = sum(len(block.split()) for block in gone)
        if 2 * lost > sum(len(block.split()) for block in article):
            gone = []
        out.append("\n\n".join(block for block in article if block not in gone))
    return out


def test_repeats_decide_blocks_of_articles_too(spark):
    """A notice without marks goes; copies, near copies and passages that fewer articles share stay."""
    notice = "This site earns a small share of what you buy here"
    many = [[words(i, 40), notice, words(100 + i, 40), "To read on"] for i in range(14)]
    few = [[words(i, 40), "a passage that only some of the articles of this host have"] for i in range(200, 209)]
    near = [[*[words(300 + k) for k in range(6)], words(400 + i, 8)] for i in range(12)]
    small = [[words(500 + i), notice] for i in range(5)]
    hosts = {"m.org": many + few, "near.org": near, "copies.org": [[words(600), notice]] * 20, "small.org": small}
    rows, want = [], {}
    for host, articles in hosts.items():
        for article, text in zip(articles, plain_notices(articles)):
            want[len(rows)] = text
            blocks = "".join(f"<p>{block}</p>" for block in article)
            rows.append((len(rows), f"http://{host}/{len(rows)}", f"<div>nav {len(rows)}</div><article>{blocks}</article>"))
    got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want
    assert got[0] == "\n\n".join([many[0][0], many[0][2], many[0][3]])
    assert sum(notice in text for text in got.values()) == 25


def test_equal_suffixes_across_partitions(spark):
    """The counts add up wherever the sorted suffixes are cut."""
    notice = "We use small files to make this site work well"
    rows = [(i, "http://h.org", f"<p>{notice}</p><p>{words(i)}</p>") for i in range(40)]
    rows += [(40 + i, "http://a.org", f"<article><p>{words(40 + i)}</p><p>{notice}</p></article>") for i in range(40)]
    copied = "<p>two pages and many copies of them do not make a run</p>"
    rows += [(80 + i, "http://c.org", f"{copied}<p>{words(80 + i % 2)}</p>") for i in range(60)]
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for partitions in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()
            assert sorted((r.page_id, r.text) for r in out) == [
                (i, words(i) if i < 80 else f"{copied[3:-4]}\n\n{words(80 + i % 2)}") for i in range(140)
            ]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_runs_inside_of_articles_and_over_them(spark):
    """Every token opens a suffix, in articles too: runs that begin within blocks, or go over blocks, are found."""
    ends = "ask the editor", "before you copy any of this text"
    rows, want = [], {}

    def page(host, source, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{len(rows)}", source))

    for i in range(12):  # a notice in two blocks, one of them shorter than a run; blocks that only begin like it stay
        own, other = words(i, 30), f"{ends[0]} {ends[1]} and {words(50 + i, 9)}"
        page("a.org", f"<article><p>{own}</p><p>{other}</p><p>{ends[0]}</p><p>{ends[1]}</p></article>", f"{own}\n\n{other}")
    teaser = words(300, 9)
    for i in range(2):  # what pages without an article repeat from articles
        page("b.org", f"<article><p>{teaser}</p><p>{words(100 + i)}</p></article>", f"{teaser}\n\n{words(100 + i)}")
    page("b.org", f"<p>{teaser}</p><p>{words(102)}</p>", words(102))
    for joined in (False, True):
        before = extraction.REPEATED_SENT
        extraction.REPEATED_SENT = -1 if joined else before
        try:
            got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
        finally:
            extraction.REPEATED_SENT = before
        assert got == want
