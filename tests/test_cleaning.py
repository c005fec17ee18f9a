"""Cleaning rules, the ledger, and whole ingestion runs."""

from __future__ import annotations

import csv
import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlark.fixed import PRODUCT_FIELDS, SALES_FIELDS, STORE_FIELDS
from ledgerlark.operators import cleaning, metrics, quality
from ledgerlark.operators.filters import SalesFilter
from ledgerlark.plans import ingest as ingest_job
from ledgerlark.plans.ingest import ingest
from ledgerlark.plans.raw_sales import raw_products, raw_sales, raw_stores
from ledgerlark.sources import csv as csv_source
from ledgerlark.sources.published import PublishedTables

STORES = [("K7", "Lantern Yard", "饺子", "河港")]
PRODUCTS = [("M1", "锅贴", "点心", "7.50"), ("M2", "绿茶", "饮料", "3.20")]
#: Two trusted rows, one imputed, one copy, and one row for each of six faults.
SALES = [
    ("T10", "2025/03/04", "K7", "M2", "5", "16.00", "card"),
    ("T11", "2025-03-04", "K8", "M1", "1", "7.50", "card"),
    ("T12", "2025-03-05", " k7", "m1 ", "2", "¥15.00", "cash"),
    ("T12", "2025-03-05", " k7", "m1 ", "2", "¥15.00", "cash"),
    ("T13", "2025-03-05", "K7", "M9", "4", "12.80", "cash"),
    ("T14", "06-03-2025", "K7", "M1", "4", " ", "card"),
    ("T15", "2025-03-06", "K7", "M2", "-3", "9.60", "card"),
    ("T16", "2025-03-06", "K7", "M1", "0", "7.50", "cash"),
    ("T17", "2025-03-06", "K7", "M2", "two", "6.40", "cash"),
    ("T18", "2025-03-07", "K7", "M1", "2", "14.00", "card"),
    ("T19", "March 7", "K7", "M1", "1", "7.50", "card"),
]


def write_csv(path, header, rows):
    with path.open("w", encoding="utf-8", newline="") as handle:
        csv.writer(handle).writerows([header, *rows])


def write_inputs(folder, sales=SALES, header=SALES_FIELDS, stores=STORES, products=PRODUCTS):
    folder.mkdir(parents=True, exist_ok=True)
    write_csv(folder / "stores.csv", STORE_FIELDS, stores)
    write_csv(folder / "products.csv", PRODUCT_FIELDS, products)
    write_csv(folder / "sales.csv", header, sales)
    return str(folder)


def check_one(spark, **changes):
    """The checked form of one raw row that differs from a clean one."""
    clean = dict(zip(SALES_FIELDS, ("T1", "2025-03-04", "K7", "M1", "2", "20.00", "cash")))
    raw = spark.createDataFrame([{"row_number": 2, **clean, **changes}])
    stores = spark.createDataFrame([("K7",)], "store_id string")
    products = spark.createDataFrame([("M1", 1000)], "product_id string, unit_price_cents long")
    return cleaning.checked(raw, stores, products).first()


@pytest.mark.parametrize(
    ("changes", "reasons", "cents", "source"),
    [
        ({}, [], 2000, "reported"),
        ({"amount": " ¥20 "}, [], 2000, "reported"),
        ({"qty": "-2", "amount": "-20"}, [], -2000, "reported"),
        ({"amount": "　"}, [], 2000, "imputed"),
        ({"amount": "", "qty": "0"}, ["missing_amount"], None, "reported"),
        ({"amount": "", "qty": "-1"}, ["missing_amount"], None, "reported"),
        ({"amount": "", "qty": "x"}, ["invalid_quantity", "missing_amount"], None, "reported"),
        ({"amount": "", "product_id": "M9"}, ["missing_amount", "unknown_product"], None, "reported"),
        ({"amount": "", "store_id": "K9"}, ["unknown_store"], 2000, "imputed"),
        ({"amount": "", "qty": str(10**18)}, ["missing_amount"], None, "reported"),
        ({"amount": "¥"}, ["invalid_amount"], None, "reported"),
        ({"amount": "1,234.00"}, ["invalid_amount"], None, "reported"),
        ({"amount": "NaN"}, ["invalid_amount"], None, "reported"),
        ({"qty": "3.0"}, ["invalid_quantity"], 2000, "reported"),
        ({"date": "05/01/2026"}, ["invalid_date"], 2000, "reported"),
        ({"amount": "21"}, ["amount_unit_price_mismatch"], 2100, "reported"),
        ({"amount": "21", "date": "x"}, ["invalid_date"], 2100, "reported"),
        ({"qty": str(10**18)}, ["amount_unit_price_mismatch"], 2000, "reported"),
        ({"qty": "0", "amount": "0.001"}, ["zero_value_transaction"], 0, "reported"),
        ({"qty": "0", "amount": "5"}, ["zero_quantity_nonzero_amount"], 500, "reported"),
        ({"qty": "2", "amount": "-20"}, ["quantity_amount_sign_conflict"], -2000, "reported"),
        (
            {"qty": "-2", "store_id": "", "product_id": "", "date": ""},
            ["invalid_date", "quantity_amount_sign_conflict", "unknown_product", "unknown_store"],
            2000,
            "reported",
        ),
    ],
)
def test_rules(spark, changes, reasons, cents, source):
    row = check_one(spark, **changes)
    assert (row.reasons, row.amount_cents, row.amount_source) == (reasons, cents, source)
    assert row.is_imputed == (source == "imputed")


def test_duplicates_are_judged_on_raw_text(spark):
    raw = spark.createDataFrame(
        [{"row_number": n, **dict(zip(SALES_FIELDS, ("T1", "2025-03-04", store, "M1", "1", "1", "x")))}
         for n, store in ((9, "K7"), (4, "K7"), (5, "k7"), (7, "K7"))]
    )
    found = cleaning.drop_exact_duplicates(raw).select("store_id", "row_number", "copies_removed")
    assert sorted(map(tuple, found.collect())) == [("K7", 4, 2), ("k7", 5, 0)]


@pytest.mark.parametrize(
    ("scale", "ledger", "revenue"),
    [
        ("0.001", (1007, 7, 9, 979, 21), 265_911_400),
        ("0.01", (10_064, 64, 99, 9_762, 238), 2_776_211_280),
    ],
)
def test_ledger_of_derived_rows(spark, scale, ledger, revenue):
    folder = f"/root/testdata/sf{scale}"
    rows = cleaning.checked(
        raw_sales(spark, folder), raw_stores(spark, folder), raw_products(spark, folder)
    )
    summary = quality.ingestion_summary(cleaning.outcomes(rows)).first()
    assert tuple(summary[name] for name in quality.COUNTS) == ledger
    assert cleaning.valid_sales(rows).agg(F.sum("amount_cents")).first()[0] == revenue
    if scale == "0.01":
        assert summary.issue_counts == {
            "amount_unit_price_mismatch": 23, "invalid_amount": 22, "invalid_date": 23,
            "invalid_quantity": 24, "missing_amount": 1, "quantity_amount_sign_conflict": 35,
            "unknown_product": 33, "unknown_store": 57, "zero_quantity_nonzero_amount": 12,
            "zero_value_transaction": 12,
        }
        assert rows.where(F.size("reasons") > 1).count() == 1


def test_ingestion_of_the_small_fixture(spark, tmp_path):
    tables = ingest(spark, write_inputs(tmp_path / "data"), str(tmp_path / "out"))
    run = tables.data_quality().first()
    assert tuple(run.summary[name] for name in quality.COUNTS) == (11, 1, 1, 3, 7)
    assert run.summary.issue_counts == {
        "amount_unit_price_mismatch": 1, "invalid_date": 1, "invalid_quantity": 1,
        "quantity_amount_sign_conflict": 1, "unknown_product": 1, "unknown_store": 1,
        "zero_quantity_nonzero_amount": 1,
    }
    assert (run.summary.date_min, run.summary.date_max) == (date(2025, 3, 4), date(2025, 3, 6))
    facts = tables.sales().orderBy("row_number").collect()
    assert [(r.row_number, r.order_id, r.date, r.store_id, r.amount_cents, r.amount_source) for r in facts] == [
        (2, "T10", date(2025, 3, 4), "K7", 1600, "reported"),
        (4, "T12", date(2025, 3, 5), "K7", 1500, "reported"),
        (7, "T14", date(2025, 3, 6), "K7", 3000, "imputed"),
    ]
    bad = {r.row_number: (json.loads(r.raw_json), r.reasons) for r in tables.quarantined_sales().collect()}
    assert sorted(bad) == [3, 6, 8, 9, 10, 11, 12]
    assert bad[3] == (dict(zip(SALES_FIELDS, SALES[1])), ["unknown_store"])
    raw = tables.raw_sales().orderBy("row_number").collect()
    assert [tuple(row) for row in raw] == [(n, *row) for n, row in enumerate(SALES, 2)]
    everything = SalesFilter(date(2025, 1, 1), date(2025, 12, 31))
    coverage = metrics.coverage(tables.star(), everything, tables.latest_run()).first()
    assert (coverage.valid_rows, coverage.ingestion_run_id) == (3, 1)
    assert coverage.updated_at is not None
    score = quality.quality_score(tables.data_quality().select("summary.*")).first()[0]
    assert score == 30  # 3 of 10


def test_failed_runs_are_not_seen_and_new_runs_win(spark, tmp_path, monkeypatch):
    data, out = write_inputs(tmp_path / "data"), str(tmp_path / "out")
    first = ingest(spark, data, out).data_quality().first()
    with monkeypatch.context() as broken:
        broken.setattr(ingest_job, "_now", lambda: 1 / 0 if broken_after() else None)
        calls = iter((False, True))
        broken_after = lambda: next(calls)  # noqa: E731 - fails at publication only
        with pytest.raises(ZeroDivisionError):
            ingest(spark, data, out)
    assert PublishedTables(spark, out).latest_run_id() == 1
    second = ingest(spark, data, out).data_quality().first()
    assert second.run_id == 2 and second.source_hash == first.source_hash
    changed = write_inputs(tmp_path / "data2", [*SALES[1:], SALES[0]])
    third = ingest(spark, changed, out).data_quality().first()
    assert third.run_id == 3 and third.source_hash != first.source_hash
    assert PublishedTables(spark, out).at_run(1).sales().count() == 3


def test_no_run_yet(spark, tmp_path):
    tables = PublishedTables(spark, str(tmp_path / "none"))
    assert tables.latest_run_id() is None and tables.data_quality().count() == 0
    with pytest.raises(LookupError):
        tables.sales()


def test_row_numbers_over_many_splits_and_files(spark, tmp_path):
    sales = [
        (f"T{i}", "2025-03-04", "K7", "M1", "1", "7.50", "x" * (i % 50)) for i in range(6000)
    ]
    folder = write_inputs(tmp_path / "data", [])
    (tmp_path / "data" / "sales.csv").rename(tmp_path / "data" / "header.txt")
    (tmp_path / "data" / "sales.csv").mkdir()
    for part in range(3):
        write_csv(
            tmp_path / "data" / "sales.csv" / f"part-{part}.csv",
            SALES_FIELDS,
            sales[part * 2000 : part * 2000 + 2000],
        )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        tables = ingest(spark, folder, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tables.read("raw_splits").count() > 10
    found = {row.order_id: row.row_number for row in tables.raw_sales().collect()}
    assert found == {f"T{i}": i + 2 for i in range(6000)}


def test_csv_forms(spark, tmp_path):
    """Absent and extra columns, byte order mark, short rows, quotes, NA, blank lines."""
    folder = write_inputs(tmp_path / "data")
    (tmp_path / "data" / "sales.csv").write_text(
        "\ufefforder_id,date,extra,store_id,product_id,qty,amount\n"
        '"T""1, a",2025-03-04,NA,K7,M1,1,10\n'
        "\n"
        "NA,2025-03-04,x,K7,M1\n"
        "\\,2025-03-04,x,K7,M1,1,\n",
        encoding="utf-8",
    )
    raw = ingest(spark, folder, str(tmp_path / "out")).raw_sales().orderBy("row_number").collect()
    assert [tuple(row) for row in raw] == [
        (2, 'T"1, a', "2025-03-04", "K7", "M1", "1", "10", ""),
        (3, "NA", "2025-03-04", "K7", "M1", "", "", ""),
        (4, "\\", "2025-03-04", "K7", "M1", "1", "", ""),
    ]


def test_quoted_line_breaks(spark, tmp_path):
    sales = [("T1", "2025-03-04", "K7", "M1", "1", "10", "a\nb"), (*SALES[0],)]
    tables = ingest(spark, write_inputs(tmp_path / "data", sales), str(tmp_path / "out"), multiline=True)
    raw = tables.raw_sales().orderBy("row_number").collect()
    assert [(row.row_number, row.payment) for row in raw] == [(2, "a\nb"), (3, "card")]


@pytest.mark.parametrize("split", ["40", "97", "1m"])
def test_quoted_line_breaks_on_split_edges_equal_python_csv(spark, tmp_path, split):
    """Breaks, blank lines, quotes, commas and header-like lines inside quotes; stray quotes outside; two files."""
    source = random.Random(3)
    bits = ["a", ",", "\n", '"', "\r\n", "\n\n", " ", "é", 'x"y', "order_id,date", ""]
    folder = tmp_path / "text.csv"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [["".join(source.choices(bits, k=source.randrange(6))) for _ in range(2)] + [str(i)] for i in range(60)]
        with (folder / name).open("w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "a.csv" else "\n")
            writer.writerow(["one", "two", "n"])
            writer.writerows(rows)
            out.write('12" wide,5" high,900\n\n   \nplain,"last\n",901')
        with (folder / name).open(encoding="utf-8", newline="") as file:
            want += [(name, *row) for row in csv.reader(file) if row and row[-1].strip() and row[-1] != "n"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = csv_source.read_text_cells(spark, str(folder), multiline=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows.sort(key=lambda r: (r.source_file, r.split_start, r.read_order))
    assert [(r.source_file.rpartition("/")[2], r.one, r.two, r.n) for r in rows] == want
    if split == "97":
        assert len({(r.source_file, r.split_start) for r in rows}) > 20


def test_open_quotes_and_other_headers_stop_multiline_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="left open"):
        csv_source.read_text_cells(spark, str(tmp_path / "a.csv"), multiline=True)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text('x,y\n1,"2\n3"\n')
    (tmp_path / "d" / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(PySparkException, match="CSV header does not conform"):
        csv_source.read_text_cells(spark, str(tmp_path / "d"), multiline=True).collect()


def test_numbers_stay_when_clocks_disagree_and_killed_runs_leave_nothing(spark, tmp_path, monkeypatch):
    data, out = write_inputs(tmp_path / "data"), str(tmp_path / "out")
    hours = iter([9, 12, 5, 6])  # the second run's clock is behind
    monkeypatch.setattr(ingest_job, "_now", lambda: datetime(2025, 1, 1, next(hours)))
    for _ in range(2):
        ingest(spark, data, out)
    tables = PublishedTables(spark, out)
    runs = {r.run_id: r for r in tables.runs().collect()}
    assert [runs[n].completed_at.hour for n in (1, 2)] == [12, 6]
    assert tables.at_latest().run == runs[2].folder
    # a run that was stopped after it wrote its row aside, and one that lost its number to another run
    killed = PublishedTables(spark, out, run="killed")
    row = {**runs[1].asDict(), "folder": "killed"}
    with monkeypatch.context() as broken:
        broken.setattr("ledgerlark.sources.files.HadoopFiles.renamed", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            killed.publish(row)
    assert tables.latest_run_id() == 2
    late = PublishedTables(spark, out, run="late")
    with monkeypatch.context() as stale:
        stale.setattr(PublishedTables, "latest_run_id", lambda self: 0)
        assert late.publish({**row, "folder": "late"}) == 3
    assert {r.run_id: r.folder for r in tables.runs().collect()} == {1: runs[1].folder, 2: runs[2].folder, 3: "late"}


def test_fingerprint_follows_the_bytes(spark, tmp_path, monkeypatch):
    from ledgerlark.sources import digest

    monkeypatch.setattr(digest, "BRANCH", 3)
    path = tmp_path / "a.csv"
    texts = ["a,b\n1,2\n", "a,b\n1,2", "a,b\r\n1,2\n", "a,b\n2,1\n", "a,b\n" + "x\n" * 50, "a,b\n" + "x\n" * 49 + "y\n"]
    seen = {}
    for text in texts:
        path.write_bytes(text.encode())
        seen[text] = digest.byte_digest(spark, {"a": str(path)})
        if len(text) < 50:
            continue
        spark.conf.set("spark.sql.files.maxPartitionBytes", "17")
        try:
            assert digest.byte_digest(spark, {"a": str(path)}) == seen[text]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(seen.values())) == len(texts)


@pytest.mark.parametrize(
    ("inputs", "text"),
    [
        ({"sales": [(*SALES[0], "more")]}, "more cells"),
        ({"sales": [SALES[0], (*SALES[1], "", "LOST")]}, "more cells"),
        ({"sales": [("T1", "2025-03-04", "K7", "M1", "1", "10", "a\nb")]}, "multiline=True"),
        ({"products": [("M1", "a", "b", "cheap")]}, "unit_price"),
        ({"products": [*PRODUCTS, (" m1", "a", "b", "1")]}, "product_id is not unique"),
        ({"stores": [*STORES, ("k7 ", "a", "b", "c")]}, "store_id is not unique"),
    ],
)
def test_inputs_that_stop_a_run(spark, tmp_path, inputs, text):
    folder = write_inputs(tmp_path / "data", **inputs)
    with pytest.raises((PySparkException, ValueError), match=text):
        ingest(spark, folder, str(tmp_path / "out"))
    assert PublishedTables(spark, str(tmp_path / "out")).latest_run_id() is None


def test_headers_of_a_folder_must_agree(spark, tmp_path):
    folder = write_inputs(tmp_path / "data", [])
    (tmp_path / "data" / "sales.csv").rename(tmp_path / "data" / "header.txt")
    (tmp_path / "data" / "sales.csv").mkdir()
    write_csv(tmp_path / "data" / "sales.csv" / "a.csv", SALES_FIELDS, SALES[:2])
    other = ("date", "order_id", *SALES_FIELDS[2:])
    write_csv(tmp_path / "data" / "sales.csv" / "b.csv", other, [(r[1], r[0], *r[2:]) for r in SALES[2:4]])
    with pytest.raises(Exception, match="CSV header does not conform"):
        ingest(spark, folder, str(tmp_path / "out"))


def test_two_runs_at_a_time_do_not_mix(spark, tmp_path, monkeypatch):
    """A run that is published while another one works gets a folder of its own."""
    data, out = write_inputs(tmp_path / "data"), str(tmp_path / "out")
    other = write_inputs(tmp_path / "other", SALES[:1])
    times = iter(range(100))
    now = ingest_job._now

    def interrupted():
        if next(times) == 1:  # the first run is about to be published
            ingest(spark, other, out)
        return now()

    with monkeypatch.context() as patched:
        patched.setattr(ingest_job, "_now", interrupted)
        ingest(spark, data, out)
    tables = PublishedTables(spark, out)
    folders = [row.folder for row in tables.runs().collect()]
    assert len(set(folders)) == 2
    assert {tables.at_run(n).raw_sales().count() for n in (1, 2)} == {1, len(SALES)}


def test_dimensions_are_broadcast_by_their_bytes(spark, monkeypatch, capsys):
    from ledgerlark.operators import filters
    from ledgerlark.sources.star import warehouse_star

    folder = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        for limit, shuffled in ((filters.BROADCAST_BYTES, False), (1, True)):
            monkeypatch.setattr(filters, "BROADCAST_BYTES", limit)
            rows = cleaning.checked(raw_sales(spark, folder), raw_stores(spark, folder), raw_products(spark, folder))
            orphans = metrics.orphan_keys(warehouse_star(spark, folder))
            for frame in (orphans, rows.where("clean_store_id = 'S1'")):
                frame.explain()
                plan = capsys.readouterr().out
                assert ("SortMergeJoin [clean_store_id" in plan or "SortMergeJoin [store_id" in plan) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_missing_input(spark, tmp_path):
    folder = write_inputs(tmp_path / "data")
    (tmp_path / "data" / "products.csv").unlink()
    with pytest.raises(FileNotFoundError, match="products.csv"):
        ingest(spark, folder, str(tmp_path / "out"))


def test_money_survives_as_whole_cents(spark):
    row = check_one(spark, qty="3", amount="30.004999999999999999999999")
    assert row.amount_cents == int(Decimal("3000")) and row.reasons == []
