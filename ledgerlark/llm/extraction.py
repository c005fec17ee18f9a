"""Main text of web pages: what markup does not decide, a host's suffix array does.

A page is read into blocks, once.  Where it marks its article, the article's
blocks are the main text, less the menus, forms, comments and so on within.
Every token of every page, in articles and outside, opens a suffix, compared to
the depth of the shortest run that counts: every longer repeated run is covered
by such beginnings.  Suffixes of a host's pages are sorted by range partitions;
equal beginnings stand side by side and their distinct pages are counted, also
where they cross partitions.

Most suffixes are met once.  So all of them are counted by short digests first,
which move as sorted differences of a few bytes each; only those whose digest
enough pages of the host have are cut out as texts, sorted and compared.  Other
digests that happen to be equal add rows to the sort and never to its result.

Pages without an article keep the runs of their blocks that nothing covers.  In
a marked article only whole blocks can go: those covered by runs that most
distinct articles of the host have are notices without marks; but an article
made mostly of such blocks is a copy and stays whole, as do passages that fewer
articles share.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate, groupby
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, located, small_batches, small_side, stored, workers_see_package

#: Tokens of the shortest repeated run, and distinct pages of a host that must have it.
RUN_TOKENS, RUN_PAGES = 6, 3

#: A run of an article is a notice if so many distinct articles of the host have it, and over that
#: share of them; no article loses over ``MOST_GONE`` of its tokens.
NOTICE_ARTICLES, NOTICE_SHARE, MOST_GONE = 10, 0.5, 0.5

#: Characters of a token that are compared as they are; longer ones are told apart by a digest.
TOKEN_CHARS = 64

#: Suffixes that go to the JVM at a time.
SUFFIX_ROWS = 20_000

#: Bits of a suffix's digest, digests that a task sorts at a time, and tokens for each bucket of them.
DIGEST_BITS, DIGESTS_AT_ONCE, BUCKET_TOKENS = 40, 1 << 22, 1 << 20

#: Digests of repeated suffixes up to this number go to the workers; more are joined.
REPEATED_SENT = 1 << 20

#: Tokens whose digests a worker remembers.
TOKENS_KNOWN = 1 << 20

MAIN, OPEN, BOILERPLATE = "main", "open", "boilerplate"

#: Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = "script style title textarea template noscript iframe object svg annotation annotation-xml select audio video canvas noembed noframes xmp"
#: Elements that end where another of them begins, and what bounds that.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
#: Elements, roles and words of class or id that are no main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button head search".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notification alert popup"
    " modal overlay newsletter subscribe subscription signup login comment comments commentlist respond disqus replies"
    " share sharing social related recommended widget widgets pager pagination toolbar skip".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{UNREAD.replace(' ', '|')})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in UNREAD.split()}
ATTRIBUTE = re.compile(
    r"\b(?P<name>class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?",
    re.IGNORECASE,
)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marks(name: str, attrs: str, inside: bool, first: bool) -> tuple[bool, bool, bool]:
    """(hidden, outside, main) of an element; ``inside`` an article a header is the
    article's own; the ``first`` article of a page is out by whole names only (comment, not
    comments-open)."""
    outside = name in OUTSIDE or (name == "header" and not inside)
    main = name in ("article", "main")
    hidden = False
    if attrs:
        for found in ATTRIBUTE.finditer(attrs):
            key, value = found["name"].lower(), found["a"] or found["b"] or found["c"] or ""
            if key in ("class", "id"):
                words = set(value.lower().split()) if first else {word.lower() for word in NAME_WORDS.findall(value)}
                outside = outside or not words.isdisjoint(OUTSIDE_WORDS)
            elif key == "role":
                main = main or value == "main"
                outside = outside or value in OUTSIDE_ROLES
            elif key == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none", value))
            else:
                hidden = hidden or key == "hidden" or value == "true"
    return hidden, outside and name not in ("html", "body", "main"), main


def page_blocks(source: str) -> list[tuple[str, str]]:
    """(text, role) of the blocks of a page in order; white space is one space, none at the ends.

    Role main: in an article; where there is none, in the element marked as
    main.  Boilerplate: in an element that is none by its name or marks.  Where
    all articles stand in such elements, the first is main nevertheless (a form
    or a layout around the page), unless an element marked as main has more text.
    """
    # name, hidden, outside, container, outside by marks within the article, number of the article
    stack: list[tuple[str, bool, bool, str, bool, int]] = [("", False, False, "", False, 0)]
    blocks: list[tuple[str, bool, str, bool, int]] = []
    parts: list[str] = []
    articles = 0

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append((text, *stack[-1][2:]))
            parts.clear()

    def pop_to(depth: int) -> None:
        if any(entry[0] in BLOCKS for entry in stack[depth:]):
            flush()
        del stack[depth:]

    at = 0
    while at < len(source):
        found = TOKEN.match(source, at)
        at = found.end()
        kind = found.lastgroup
        if kind == "text":
            if not stack[-1][1]:
                text = found["text"]
                parts.append(html.unescape(text) if "&" in text else text)
            continue
        if found["raw"]:
            ending = RAW_END[found["raw"].lower()].search(source, at)
            if found["raw"].lower() == "svg" and (found[0].endswith("/>") or not ending):
                continue
            at = ending.end() if ending else len(source)
            continue
        if not found["name"]:
            continue
        name = found["name"].lower()
        if found["close"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                pop_to(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            ends, bounds = ENDED_BY.get(name, ({"p"}, {"button", "td", "th", "caption", "table", "object"}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in ends:
                    pop_to(i)
                    break
            if name == "body":
                pop_to(next((i for i, entry in enumerate(stack) if entry[0] == "head"), len(stack)))
        if name in VOID or found["attrs"].endswith("/") and name not in BLOCKS:
            continue
        _, hidden, outside, container, inner, number = stack[-1]
        new_hidden, new_outside, main = _marks(
            name, found["attrs"], bool(container), name == "article" and not articles
        )
        articles += name == "article"
        inner = inner or new_outside
        if main and not new_outside and container != "article":
            container = "article" if name == "article" else "main"
            if name == "article":
                inner, number = False, articles
        stack.append((name, hidden or new_hidden, outside or new_outside, container, inner, number))
    flush()
    marked = {container for _, outside, container, _, _ in blocks if container and not outside}
    wanted = "article" if "article" in marked else "main" if marked else None
    if wanted != "article":
        first = min((number for *_, container, inner, number in blocks if container == "article" and not inner), default=0)
        wrapped = [number == first > 0 and container == "article" and not inner for *_, container, inner, number in blocks]
        size = sum(len(block[0]) for block, own in zip(blocks, wrapped) if own)
        if size > sum(len(text) for text, outside, container, _, _ in blocks if container and not outside):
            return [
                (block[0], MAIN if own else BOILERPLATE if block[1] else OPEN) for block, own in zip(blocks, wrapped)
            ]
    return [
        (text, BOILERPLATE if outside else MAIN if wanted and container == wanted else OPEN)
        for text, outside, container, _, _ in blocks
    ]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def stream_of(blocks: list[tuple[str, str]]) -> list[str]:
    """Tokens of all blocks of a page, in articles and outside."""
    return [token for text, _ in blocks for token in text.split(" ")]


def _beginning(tokens: list[str]) -> str:
    return "\n".join(
        t if len(t) <= TOKEN_CHARS else t[: TOKEN_CHARS // 2] + xxhash.xxh3_128_hexdigest(t) for t in tokens
    )


def _short_blocks(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(start, tokens, text) of the blocks shorter than a run."""
    start = 0
    for text in texts:
        n = text.count(" ") + 1
        if n < RUN_TOKENS:
            yield start, n, text
        start += n


def suffixes(blocks: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, tokens, beginning) of every suffix of a page, and of every shorter block.

    Tokens have no line feeds; one at the end marks the end of a block.
    """
    stream = stream_of(blocks)
    found = [
        (i, RUN_TOKENS, _beginning(stream[i : i + RUN_TOKENS])) for i in range(len(stream) - RUN_TOKENS + 1)
    ]
    short = _short_blocks([text for text, _ in blocks])
    return found + [(start, n, _beginning(text.split(" ")) + "\n") for start, n, text in short]


class _TokenDigests(dict):
    """Digests of tokens, as they are asked for."""

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS_KNOWN:
            self.clear()
        digest = self[token] = xxhash.xxh64_intdigest(token)
        return digest


def _suffix_digests(host: str, texts: list[str], stream: list[str], known: _TokenDigests) -> np.ndarray:
    """Digests of a page's ``suffixes``, in their order, with the host."""
    ids = np.fromiter(map(known.__getitem__, stream), np.uint64, len(stream))
    n = max(len(ids) - RUN_TOKENS + 1, 0)
    runs = np.zeros(n, np.uint64)
    for k in range(RUN_TOKENS):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    short = np.array([xxhash.xxh64_intdigest(text, seed=1) for _, _, text in _short_blocks(texts)], np.uint64)
    mixed = np.concatenate([runs, short]) ^ np.uint64(xxhash.xxh64_intdigest(host, seed=2))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(factor)
    return mixed >> np.uint64(64 - DIGEST_BITS)


def _among(digests: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Which of the digests are in the sorted ones."""
    return met[np.searchsorted(met[:-1], digests)] == digests


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a value, planes of bytes); the planes of small numbers hold little."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return width, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(n: int, width: int, data: bytes) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _own_blocks(blocks: list[tuple[str, str]], covered: list[tuple[int, int]]) -> list[str]:
    """Blocks of an article that no repeated run covers whole; all of them if too much would go."""
    gone = {i for start, n in covered for i in range(start, start + n)}
    kept, start, lost, size = [], 0, 0, 0
    for text, role in blocks:
        n = text.count(" ") + 1
        if role == MAIN:
            size += n
            if gone.issuperset(range(start, start + n)):
                lost += n
            else:
                kept.append(text)
        start += n
    return kept if lost <= MOST_GONE * size else [text for text, role in blocks if role == MAIN]


def unique_text(blocks: list[tuple[str, str]], covered: list[tuple[int, int]]) -> str:
    """The article's own blocks; without an article, the runs of undecided blocks that no repeated run covers.

    ``covered`` has the (start, n) of repeated runs among the tokens of all
    blocks.  Without an article, the rest of a repeated run that reaches into a
    block is not removed from it: of a block only long runs go, or all of it.
    """
    if any(role == MAIN for _, role in blocks):
        return "\n\n".join(_own_blocks(blocks, covered))
    gone = {i for start, n in covered for i in range(start, start + n)}
    kept, start = [], 0
    for text, role in blocks:
        tokens = text.split(" ")
        left: list[str] = []
        for covered_run, run in groupby(enumerate(tokens, start), lambda x: x[0] in gone):
            own = [token for _, token in run]
            if not covered_run or len(own) < min(RUN_TOKENS, len(tokens)):
                left += own
        start += len(tokens)
        if role == OPEN and left:
            kept.append(" ".join(left))
    return "\n\n".join(kept)


def read_pages(rows: DataFrame) -> DataFrame:
    """``rows`` with a page's blocks instead of its html, written: host, texts, roles, hashes, size.

    ``stream`` is the hash of all ``tokens``, ``article`` that of the article's
    blocks; ``open`` tells that the page marks none.
    """

    @F.pandas_udf("host string, texts array<string>, roles array<string>, stream long, article long, open boolean, tokens int")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        digest = lambda tokens: xxhash.xxh64_intdigest("\n".join(tokens)) - (1 << 63)
        for urls, sources in batches:
            out = []
            for url, source in zip(urls, sources):
                blocks = page_blocks(source or "")
                article = [text for text, role in blocks if role == MAIN]
                stream = stream_of(blocks)
                out.append((
                    host_of(url), [text for text, _ in blocks], [role for _, role in blocks],
                    digest(stream), digest(article), not article, len(stream),
                ))
            yield pd.DataFrame(out, columns=["host", "texts", "roles", "stream", "article", "open", "tokens"])

    return stored(rows.withColumn("read", read("url", "html")).select(*PLACE, "page_id", "url", "read.*"), "blocks", "zstd")


def _needed(pages: DataFrame) -> DataFrame:
    """(host, has_open, articles, need): a suffix met in fewer than ``need`` pages of the host decides nothing.

    ``need`` is rounded down to a power of two, so hosts have few different ones.
    """
    most = F.floor(F.col("articles") * NOTICE_SHARE) + 1
    least = F.when(F.col("has_open"), RUN_PAGES).otherwise(F.greatest(F.lit(NOTICE_ARTICLES), most))
    return (
        pages.groupBy("host")
        .agg(F.bool_or("open").alias("has_open"), F.count_distinct(F.when(~F.col("open"), F.col("article"))).alias("articles"))
        .withColumn("need", F.when(least < 4, least).otherwise(F.pow(F.lit(2), F.floor(F.log2(least.cast("double"))))).cast("long"))
    )


def _often_met(pages: DataFrame) -> DataFrame:
    """(need, digest) of the suffixes whose digest at least ``need`` pages have; equal pages count once.

    ``pages`` has (host, stream, article, texts, tokens, need) of every page.  A
    digest takes two or three bytes while it moves: tasks sort theirs, and
    differences of neighbours go by buckets of the digests' first bits.
    """
    same = ["host", "stream", "article"]
    several = (
        pages.groupBy(*same)
        .agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .drop("times")
    )
    several = small_side(stored(several, "copied-pages"), F.length("host") + 48)
    copies = pages.select(*PLACE, *same).join(several, same).where(F.struct(*PLACE) != F.col("first")).select(*PLACE)
    copies = small_side(stored(copies, "copies"), 32)
    tokens = pages.agg(F.sum("tokens")).first()[0] or 0
    low_bits = DIGEST_BITS - min((tokens // BUCKET_TOKENS).bit_length(), 16)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["need", "bucket", "n", "width", "steps", "count_width", "counts"]
        known, waiting, size = _TokenDigests(), {}, 0

        def out() -> pd.DataFrame:
            rows = []
            for need, parts in waiting.items():
                digests, counts = np.unique(np.concatenate(parts), return_counts=True)
                buckets = digests >> np.uint64(low_bits)
                ends = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(digests)]
                for a, b in zip(ends, ends[1:]):
                    if a < b:
                        places = digests[a:b] & np.uint64((1 << low_bits) - 1)
                        steps = np.diff(places, prepend=np.uint64(0))
                        rows.append((need, int(buckets[a]), b - a, *_packed(steps), *_packed(counts[a:b])))
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            for host, texts, need in zip(batch["host"], batch["texts"], batch["need"]):
                texts = list(texts)
                found = np.unique(_suffix_digests(host, texts, " ".join(texts).split(" ") if texts else [], known))
                waiting.setdefault(need, []).append(found)
                size += len(found)
                if size >= DIGESTS_AT_ONCE:
                    yield out()
                    waiting, size = {}, 0
        yield out()

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        need, bucket = key
        steps = [_unpacked(*row) for row in zip(rows["n"], rows["width"], rows["steps"])]
        places = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps])
        counts = np.concatenate([_unpacked(*row) for row in zip(rows["n"], rows["count_width"], rows["counts"])])
        order = np.argsort(places, kind="stable")
        places, counts = places[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        often = places[starts[np.add.reduceat(counts, starts) >= need]]
        return pd.DataFrame({"need": need, "digest": often.astype(np.int64) + (int(bucket) << low_bits)})

    sorted_digests = pages.join(copies, PLACE, "left_anti").select("host", "texts", "need").mapInPandas(
        sort, "need long, bucket long, n int, width int, steps binary, count_width int, counts binary"
    )
    return stored(sorted_digests.groupBy("need", "bucket").applyInPandas(count, "need long, digest long"), "repeated-digests")


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(place, covered) of pages with repeated runs; ``pages`` as ``read_pages`` gives them.

    ``covered`` lists (start, n) of token runs that ``RUN_PAGES`` distinct pages
    of the host share, or, in an article, most articles of the host.  Pages with
    equal streams count once, and so do equal articles.
    """
    hosts = stored(_needed(pages), "hosts")
    known = pages.join(small_side(hosts, F.length("host") + 40), "host").select(
        *PLACE, "host", "texts", "roles", "stream", "article", "open", "tokens", "has_open", "need"
    )
    often = _often_met(known)
    sent, cut_from = None, known
    if often.count() <= REPEATED_SENT:
        met = often.toPandas()
        sent = pages.sparkSession.sparkContext.broadcast(
            {need: np.sort(group.to_numpy().astype(np.uint64)) for need, group in met.groupby("need")["digest"]}
        )
        cut_from = known.where(F.col("need").isin(met["need"].unique().tolist()))  # no other page has one

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*PLACE, "host", "page", "decides", "start", "n", "beginning", "need", "digest"]
        digests_of, rows = _TokenDigests(), []
        for batch in batches:
            for file, place, host, texts, roles, stream, article, is_open, _, has_open, need in batch.itertuples(index=False):
                texts = list(texts)
                tokens = " ".join(texts).split(" ") if texts else []
                digests = _suffix_digests(host, texts, tokens, digests_of)
                places = np.arange(len(digests))
                if sent is not None:
                    places = places[_among(digests, sent.value[need])]
                if not len(places):
                    continue
                runs = max(len(tokens) - RUN_TOKENS + 1, 0)
                short = [(start, n, _beginning(text.split(" ")) + "\n") for start, n, text in _short_blocks(texts)]
                ends = list(accumulate(text.count(" ") + 1 for text in texts))
                inside = np.repeat([role == MAIN for role in roles], np.diff(ends, prepend=0))
                within = np.concatenate([[0], np.cumsum(inside)])
                for i in places.tolist():
                    start, n, beginning = (
                        (i, RUN_TOKENS, _beginning(tokens[i : i + RUN_TOKENS])) if i < runs else short[i - runs]
                    )
                    if i < runs and within[i + n] - within[i] == n:
                        rows.append((file, place, host, article, True, start, n, beginning + "\n\n", need, int(digests[i])))
                    if has_open:
                        rows.append((file, place, host, stream, is_open, start, n, beginning, need, int(digests[i])))
                if len(rows) >= SUFFIX_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)

    found = cut_from.mapInPandas(
        cut,
        f"{PLACE[0]} long, {PLACE[1]} long, host string, page long, decides boolean, start int, n int, beginning string,"
        " need long, digest long",
    )
    if sent is None:
        found = found.join(often, ["need", "digest"], "left_semi")
    found = stored(found.drop("need", "digest"), "suffixes", "zstd")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pages of equal neighbours; the first and last of a partition whatever their number.

        The first and last page are named, as another partition may have them too.
        """
        columns = ["host", "beginning", "inner_pages", "end_pages"]
        last, edge, first_page, last_page, count = None, True, 0, 0, 0

        def counted() -> tuple[str, str, int, list[int]]:
            ends = sorted({first_page, last_page})
            return (*last, count - len(ends), ends)

        for batch in batches:
            rows = []
            for *here, page in zip(batch["host"], batch["beginning"], batch["page"]):
                if here == last:
                    count += page != last_page
                    last_page = page
                    continue
                if last is not None:
                    if edge or count >= RUN_PAGES:
                        rows.append(counted())
                    edge = False
                last, first_page, last_page, count = here, page, page, 1
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([] if last is None else [counted()], columns=columns)

    order = ["host", "beginning", "page"]
    counted = stored(
        found.select(*order, PLACE[1])
        .repartitionByRange(*order, PLACE[1])
        .sortWithinPartitions(*order)
        .select(*order)
        .mapInPandas(compare, "host string, beginning string, inner_pages long, end_pages array<long>")
        .groupBy("host", "beginning")
        .agg((F.sum("inner_pages") + F.size(F.array_distinct(F.flatten(F.collect_list("end_pages"))))).alias("pages"))
        .where(F.col("pages") >= RUN_PAGES),
        "repeated-suffixes",
    )
    of_article = F.col("beginning").endswith("\n\n")
    most = (F.col("pages") >= NOTICE_ARTICLES) & (F.col("pages") > F.col("articles") * NOTICE_SHARE)
    shared = (
        counted.join(small_side(hosts.select("host", "articles"), F.length("host") + 40), "host")
        .where(~of_article | most)
        .select("host", "beginning")
    )
    shared = small_side(stored(shared, "shared-suffixes"), F.length("host") + F.length("beginning") + 40)
    return (
        found.where("decides")
        .join(shared, ["host", "beginning"], "left_semi")
        .groupBy(*PLACE)
        .agg(F.collect_list(F.struct("start", "n")).alias("covered"))
    )


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``text`` is the blocks of the main text, joined by two line feeds, with
    character references decoded; empty if there is none, as for null or empty
    HTML.  A null URL belongs to the host ''.  Repeated rows are pages of their
    own.  An empty table gives no rows.
    """
    workers_see_package(pages.sparkSession)
    rows = located(pages).select(
        *PLACE, F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    with small_batches(pages.sparkSession):
        read = read_pages(rows)
        runs = small_side(stored(repeated_runs(read), "covered-runs"), F.size("covered") * 16 + 40)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, roles, covered in batches:
            yield pd.Series([
                unique_text(list(zip(*page)), [] if runs is None else [(x["start"], x["n"]) for x in runs])
                for *page, runs in zip(texts, roles, covered)
            ], dtype=object)

    return (
        read.join(runs, PLACE, "left")
        .select("page_id", "url", text_of("texts", "roles", "covered").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
