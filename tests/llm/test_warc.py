from __future__ import annotations

import base64
import gzip
import hashlib

from pyarrow import fs

from ledgerlark.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/x", "<p>one</p>"), (5, "http://a/y", "<p>one</p>"), (3, None, "<p>one</p>"),
    (7, "http://b/\r\nX: y é", "<p>twö \U0001f600</p>"), (8, "http://b", None), (9, "http://c", ""),
    (10, "u", "WARC/1.1\r\n\r\n" * 30000), (None, "v", "<p>one</p>"), (None, None, None),
    (11, "u", "z"), (11, "u", "z"),
]


def pages(spark):
    return spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' as digest", "'y' as payload").coalesce(2)


def test_round_trip(spark):
    rows = warc.round_trip(pages(spark)).collect()
    groups = {}
    for page, _, html in ROWS:
        groups.setdefault(html or "", []).append(page)
    want = []
    for html, members in groups.items():
        largest = max((m for m in members if m is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        response = members.index(largest)
        for i, page in enumerate(members):
            kind = "response" if i == response else "revisit"
            want.append((page, len(html.encode()), digest, kind, None if i == response else largest))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(str(r.url) for r in rows) == sorted(str(u) for _, u, _ in ROWS)


def test_small_payloads_are_all_responses(spark):
    index = warc.write_archives(pages(spark), min_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in index.where("page_id in (8, 9, 11, 1)").collect()}
    assert kinds == {(8, "response"), (9, "response"), (11, "response"), (1, "revisit")}


def test_selected_records_and_whole_files(spark):
    index = warc.write_archives(pages(spark))
    chosen = warc.read_records(index.where("page_id in (7, 10)")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in chosen} == {7: ROWS[3][2], 10: ROWS[6][2]}
    total = 0
    for r in index.select("archive").distinct().collect():
        store, path = fs.FileSystem.from_uri(r.archive)
        with store.open_input_stream(path, compression=None) as file:
            total += gzip.decompress(file.read()).count(b"WARC-Record-ID: ")
    assert total == len(ROWS)


def test_neighbouring_ranges_are_read_together():
    import pandas as pd

    index = pd.DataFrame(
        [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.MAX_GAP + 1, 5), ("b", 0, 3), ("b", 3, warc.MAX_RUN)],
        columns=["archive", "offset", "length"],
    )
    assert [len(run) for run in warc.runs_of(index)] == [2, 1, 1, 1]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
