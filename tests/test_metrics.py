"""The metric layer on a seven-line star."""

from __future__ import annotations

from datetime import date

import pytest

from ledgerlark.operators import catalogue, metrics
from ledgerlark.operators.filters import SalesFilter, require_known_store
from ledgerlark.sources.star import SalesStar

TWO_DAYS = SalesFilter(date(2025, 9, 10), date(2025, 9, 11))


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def with_filter(**filters):
    return SalesFilter(TWO_DAYS.start_date, TWO_DAYS.end_date, **filters)


def test_totals_count_orders_once(small_star):
    assert rows(metrics.totals(small_star, TWO_DAYS)) == [(7600, 4, 1900)]
    assert rows(metrics.daily(small_star, TWO_DAYS)) == [
        (date(2025, 9, 10), 4400, 1, 4400),
        (date(2025, 9, 11), 3200, 3, 1067),
    ]


def test_rankings(small_star):
    products = metrics.top_products(small_star, TWO_DAYS)
    assert rows(products.select("rank", "product_name", "quantity", "revenue_cents", "order_count")) == [
        (1, "酸辣粉", 4, 4800, 2),
        (2, "豆浆", 7, 2800, 3),
    ]
    stores = metrics.store_comparison(small_star, TWO_DAYS)
    assert rows(stores.select("store_name", "revenue_cents", "share_percent")) == [
        ("Quay Kitchen", 4800, 63.2),
        ("Hill Kitchen", 2800, 36.8),
    ]
    assert rows(metrics.top_entities(small_star, "store_category", TWO_DAYS, 5)) == [
        ("小吃", 4800, 2),
        ("火锅", 2800, 2),
    ]


def test_summary_with_store_and_previous_period(small_star):
    row = metrics.dashboard_summary(small_star, with_filter(store_id=" n2 ")).first()
    assert (row.revenue_cents, row.order_count) == (2800, 2)
    assert (row.previous_revenue_cents, row.previous_order_count) == (1200, 1)
    assert (row.revenue_change_percent, row.order_change_percent) == (133.3, 100.0)
    assert row.average_order_value_change_percent == 16.7


@pytest.mark.parametrize(
    ("filters", "wanted"),
    [
        ({"product_name": " 酸辣粉 "}, (4800, 2, 2400)),
        ({"product_name": "酸辣"}, (0, 0, None)),
        ({"store_category": "火锅"}, (2800, 2, 1400)),
        ({"store_id": ""}, (7600, 4, 1900)),
        ({"store_id": "N9"}, (0, 0, None)),
        ({"store_id": "n1", "product_name": "豆浆", "store_category": "小吃"}, (1200, 2, 600)),
    ],
)
def test_filters(small_star, filters, wanted):
    report = metrics.revenue_report(small_star, with_filter(**filters)).first()
    assert tuple(report)[:3] == wanted
    assert report.start_date == TWO_DAYS.start_date


def test_unverified_keys_drop_orphans(spark, small_star):
    orphan = spark.createDataFrame(
        [("A9", date(2025, 9, 10), "N1", "D9", 1, 700), ("A8", date(2025, 9, 10), "N9", "D1", 1, 900)],
        small_star.sales.schema,
    )
    loose = SalesStar(small_star.sales.unionByName(orphan), small_star.stores, small_star.products)
    assert rows(metrics.totals(loose, TWO_DAYS)) == [(7600, 4, 1900)]
    assert rows(metrics.top_products(loose, TWO_DAYS)) == rows(metrics.top_products(small_star, TWO_DAYS))
    assert rows(metrics.store_comparison(loose, TWO_DAYS)) == rows(
        metrics.store_comparison(small_star, TWO_DAYS)
    )
    assert rows(metrics.star_join(loose, TWO_DAYS).select("order_id")).count(("A9",)) == 0
    assert rows(metrics.orphan_keys(loose)) == [(9, 1, 1)]


def test_ties_go_by_id_and_by_name(spark, small_star):
    sales = spark.createDataFrame(
        [(f"A{i}", date(2025, 9, 10), "N1", f"D{i}", 1, 100) for i in range(15, 0, -1)],
        small_star.sales.schema,
    )
    products = spark.createDataFrame(
        [(f"D{i}", f"name{i}", "c", 100) for i in range(1, 16)], small_star.products.schema
    )
    star = SalesStar(sales, small_star.stores, products, keys_verified=True)
    ids = [row.product_id for row in metrics.top_products(star, TWO_DAYS).collect()]
    assert ids == sorted(f"D{i}" for i in range(1, 16))[:10]
    names = [row.name for row in metrics.top_entities(star, "product", TWO_DAYS, 3).collect()]
    assert names == ["name1", "name10", "name11"]


def test_comparisons(small_star):
    overlap = metrics.compare_periods(
        small_star, "order_count", TWO_DAYS, date(2025, 9, 9), date(2025, 9, 10)
    )
    assert rows(overlap) == [("order_count", 4, 2, 100.0, "up")]
    no_baseline = metrics.compare_periods(
        small_star, "average_order_value", TWO_DAYS, date(2020, 1, 1), date(2020, 1, 2)
    )
    assert rows(no_baseline) == [("average_order_value", 1900, None, None, "flat")]
    zero = metrics.compare_periods(
        small_star, "revenue", TWO_DAYS, date(2020, 1, 1), date(2020, 1, 2)
    )
    assert rows(zero) == [("revenue", 7600, 0, None, "up")]


def test_trend_and_coverage(small_star):
    assert rows(metrics.trend(small_star, "average_order_value", with_filter(store_id="N1"))) == [
        (date(2025, 9, 10), 4400),
        (date(2025, 9, 11), 400),
    ]
    assert rows(metrics.coverage(small_star, TWO_DAYS)) == [(5, date(2025, 9, 10), date(2025, 9, 11))]
    empty = SalesFilter(date(2030, 1, 1), date(2030, 1, 1))
    assert rows(metrics.coverage(small_star, empty)) == [(0, None, None)]
    assert rows(metrics.trend(small_star, "revenue", empty)) == []


def test_catalogue(spark, small_star):
    assert rows(catalogue.date_bounds(small_star)) == [(date(2025, 8, 20), date(2025, 9, 11))]
    assert [row.store_id for row in catalogue.store_options(small_star).collect()] == ["N1", "N2"]
    assert [row.product_id for row in catalogue.product_options(small_star).collect()] == ["D1", "D2"]
    assert rows(catalogue.calendar_presets(small_star)) == [
        ("全部数据", date(2025, 8, 20), date(2025, 9, 11)),
        ("八月", date(2025, 8, 1), date(2025, 8, 31)),
        ("九月", date(2025, 9, 1), date(2025, 9, 30)),
    ]
    nothing = SalesStar(small_star.sales.limit(0), small_star.stores, small_star.products)
    assert rows(catalogue.calendar_presets(nothing)) == []


def test_wrong_requests_are_rejected_before_any_query(small_star):
    with pytest.raises(ValueError, match="start_date"):
        SalesFilter(date(2025, 9, 12), date(2025, 9, 11))
    with pytest.raises(ValueError, match="start_date"):
        metrics.compare_periods(small_star, "revenue", TWO_DAYS, date(2025, 9, 12), date(2025, 9, 11))
    with pytest.raises(ValueError, match="metric"):
        metrics.compare_periods(small_star, "profit", TWO_DAYS, date(2025, 9, 10), date(2025, 9, 11))
    with pytest.raises(ValueError, match="metric"):
        metrics.trend(small_star, "profit", TWO_DAYS)
    with pytest.raises(ValueError, match="daily"):
        metrics.trend(small_star, "revenue", TWO_DAYS, "week")
    with pytest.raises(ValueError, match="dimension"):
        metrics.top_entities(small_star, "city", TWO_DAYS)
    with pytest.raises(ValueError, match="metric"):
        metrics.top_entities(small_star, "store", TWO_DAYS, metric="order_count")
    for limit in (0, 21):
        with pytest.raises(ValueError, match="limit"):
            metrics.top_entities(small_star, "store", TWO_DAYS, limit)


def test_warehouse_facts_without_a_partner_do_not_count(spark, tmp_path):
    """The star over files drops orphans, as an inner join does."""
    from pyspark.sql import functions as F

    from ledgerlark.sources.star import warehouse_star

    folder = "/root/testdata/sf0.001"
    for name in ("nation", "region", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orphan = lines.limit(1).withColumn("l_partkey", F.lit(10**6).cast(lines.schema["l_partkey"].dataType))
    lines.unionByName(orphan).write.parquet(str(tmp_path / "lineitem.parquet"))
    everything = SalesFilter(date(1990, 1, 1), date(2010, 12, 31))
    found = rows(metrics.totals(warehouse_star(spark, str(tmp_path)), everything))
    assert found == rows(metrics.totals(warehouse_star(spark, folder), everything))


def test_files_are_verified_once_for_each_state(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerlark.sources import proof
    from ledgerlark.sources.star import warehouse_star

    folder = "/root/testdata/sf0.001"
    for name in ("nation", "region", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    checks = []
    verified = proof._verified
    monkeypatch.setattr(proof, "_verified", lambda star: checks.append(1) or verified(star))
    monkeypatch.setattr(proof, "_home", lambda spark: str(tmp_path / "shared"))
    star = warehouse_star(spark, str(tmp_path))
    assert star.keys_verified and checks == [1]
    assert star.dates() == tuple(star.sales.agg(F.min("date"), F.max("date")).first())
    warehouse_star(spark, str(tmp_path))
    proof._KNOWN.clear()  # as another application would find it
    assert warehouse_star(spark, str(tmp_path)).keys_verified and checks == [1]
    orphan = lines.limit(1).withColumn("l_suppkey", F.lit(10**6).cast(lines.schema["l_suppkey"].dataType))
    orphan.write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert not warehouse_star(spark, str(tmp_path)).keys_verified and checks == [1, 1]


def test_dashboards_refuse_an_unknown_store(small_star):
    for build in (metrics.dashboard_summary, metrics.daily, metrics.top_products, metrics.store_comparison, metrics.coverage):
        with pytest.raises(ValueError, match="unknown store_id"):
            build(small_star, with_filter(store_id="nowhere"))


def test_known_store(small_star):
    assert require_known_store(small_star, " n1 ") == "N1"
    assert require_known_store(small_star, " ") is None
    with pytest.raises(ValueError, match="unknown store_id: N9"):
        require_known_store(small_star, "n9")


def test_plans_stay_in_the_jvm_and_push_filters_down(spark, capsys):
    from ledgerlark.sources.star import warehouse_star

    star = warehouse_star(spark, "/root/testdata/sf0.001")
    frame = metrics.top_products(star, SalesFilter(date(1997, 1, 1), date(1997, 12, 31), store_id=3))
    frame.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate" in plan and "EqualTo(l_suppkey,3)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_dashboards_from_rollups_equal_those_from_facts(spark, small_star):
    """Orders on several days, in several stores and on a third of all lines; ranges that start within orders."""
    import random
    from dataclasses import replace
    from datetime import timedelta

    from ledgerlark.operators.rollups import rollups

    source = random.Random(2)
    first = date(2025, 3, 1)
    facts = [
        ("HOT" if source.random() < 0.3 else f"O{source.randrange(40)}", first + timedelta(days=source.randrange(30)),
         source.choice(["N1", "N2"]), source.choice(["D1", "D2"]), source.randrange(1, 5), source.randrange(-200, 900))
        for _ in range(300)
    ]
    star = replace(small_star, sales=spark.createDataFrame(facts, small_star.sales.schema))
    rolled = replace(star, rollups=rollups(star.sales).cache(), sales=star.sales.where("cast(raise_error('facts are not read') as boolean)"))
    for start, length, store in ((4, 9, None), (13, 5, "N2"), (40, 5, None)):
        where = SalesFilter(first + timedelta(days=start), first + timedelta(days=start + length), store_id=store)
        before = (where.start_date - timedelta(days=7), where.start_date + timedelta(days=3))
        for build in (
            metrics.totals, metrics.dashboard_summary, metrics.daily, metrics.top_products, metrics.store_comparison,
            metrics.coverage, lambda s, w: metrics.trend(s, "order_count", w),
            lambda s, w: metrics.compare_periods(s, "average_order_value", w, *before),
        ):
            assert rows(build(rolled, where)) == rows(build(star, where)), (where, build)
