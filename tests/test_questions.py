"""History, intents, product search, tool calls and answers."""

from __future__ import annotations

import json
import random
from datetime import date

import pytest

from ledgerlark import fixed
from ledgerlark.operators import answers, batch, questions, tools
from ledgerlark.sources.star import SalesStar

MESSAGE = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def star(spark, small_star):
    """Three months of sales; the last one sells far more per order."""
    sales = spark.createDataFrame(
        [
            ("E1", date(2025, 2, 3), "N1", "D1", 1, 1200),
            ("E2", date(2025, 3, 8), "N1", "D1", 3, 3600),
            ("E3", date(2025, 3, 9), "N2", "D2", 1, 400),
            ("E4", date(2025, 4, 30), "N2", "D1", 5, 600000),
        ],
        small_star.sales.schema,
    )
    return SalesStar(sales, small_star.stores, small_star.products, keys_verified=True)


def conversation(spark, *texts, conv_id=1):
    rows = [(conv_id, n, role, text) for n, (role, text) in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGE)


def ask(spark, star, quality_run, *texts):
    """The answer to the last message."""
    messages = conversation(spark, *texts)
    rows = answers.answer_messages(messages, star, quality_run).collect()
    return max(rows, key=lambda row: row.turn)


def test_product_revenue(spark, star, quality_run):
    row = ask(spark, star, quality_run, ("user", "请问三月酸辣粉的营业额"))
    assert (row.status, row.tool, row.ingestion_run_id) == ("answered", "get_revenue", 7)
    assert json.loads(row.parameters) == {
        "start_date": "2025-03-01", "end_date": "2025-03-31", "product_name": "酸辣粉",
        "store_id": None, "store_category": None,
    }
    assert json.loads(row.result)["revenue_cents"] == 3600
    assert row.answer == "酸辣粉在 2025-03-01 至 2025-03-31 的营业额为 ¥36.00，覆盖 1 个订单。"
    assert (row.action.start_date, row.action.highlight_product) == (date(2025, 3, 1), "酸辣粉")
    assert row.generated_at is not None


def test_follow_up_keeps_the_product(spark, star, quality_run):
    row = ask(
        spark, star, quality_run,
        ("user", "请问三月酸辣粉的营业额"), ("assistant", "三月酸辣粉见上图"), ("user", "换成二月呢"),
    )
    parameters = json.loads(row.parameters)
    assert (parameters["product_name"], parameters["start_date"], parameters["end_date"]) == (
        "酸辣粉", "2025-02-01", "2025-02-28",
    )
    assert json.loads(row.result)["revenue_cents"] == 1200


def test_ranking_comparison_and_quality(spark, star, quality_run):
    row = ask(spark, star, quality_run, ("user", "门店里第一的品类"))
    assert json.loads(row.result)["items"] == [
        {"name": "火锅", "value_cents": 600400, "order_count": 2}
    ]
    assert row.answer == "营业额最高的是“火锅”，营业额为 ¥6,004.00。"
    row = ask(spark, star, quality_run, ("user", "看看客单价趋势"))
    assert json.loads(row.result) == {
        "metric": "average_order_value", "current_value": 600000, "previous_value": 2000,
        "change_percent": 29900.0, "direction": "up",
    }
    assert row.answer == "最近一个完整月的客单价为 ¥6,000.00，相比上月上涨 29900.0%。"
    assert (row.action.start_date, row.action.end_date) == (date(2025, 4, 1), date(2025, 4, 30))
    row = ask(spark, star, quality_run, ("user", "列出脏数据"))
    assert row.answer == "原始数据 5,208 行，清洗后有效 5,160 行，隔离 37 行。"
    assert row.action is None and row.parameters == "{}"
    assert json.loads(row.result)["rule_version"] == "test"


def test_unsupported(spark, star, quality_run):
    row = ask(spark, star, quality_run, ("user", "帮我订一张票"))
    assert (row.status, row.answer) == ("unsupported", fixed.OUT_OF_SCOPE_TEXT)
    assert row.tool is None and row.result is None and row.action is None
    empty = SalesStar(star.sales.limit(0), star.stores, star.products, keys_verified=True)
    row = ask(spark, empty, quality_run, ("user", "列出脏数据"))
    assert (row.status, row.answer) == ("unsupported", fixed.NO_DATES_TEXT)


def plan_of(spark, star, *texts):
    asked = questions.questions(questions.with_history(conversation(spark, *texts)))
    rows = questions.plan(asked, star).collect()
    return max(rows, key=lambda row: row.turn)


def test_month_rules(spark, star):
    row = plan_of(spark, star, ("user", "豆浆 十一月 销售"))
    assert json.loads(row.arguments)["start_date"] == "2025-11-01"
    row = plan_of(spark, star, ("user", "豆浆十二月"), ("user", "豆浆多少"))
    assert json.loads(row.arguments)["end_date"] == "2025-12-31"
    row = plan_of(spark, star, ("user", "豆浆多少"))
    assert json.loads(row.arguments)["start_date"] == "2025-02-03"
    assert json.loads(row.arguments)["end_date"] == "2025-04-30"
    assert plan_of(spark, star, ("user", "豆浆二月呢")).status == "unsupported"


def test_request_checks(spark, star):
    assert plan_of(spark, star, ("user", "问" * 501)).status == "invalid"
    assert plan_of(spark, star, ("user", "问" * 500)).status == "unsupported"
    assert plan_of(spark, star, ("user", "")).status == "invalid"
    assert plan_of(spark, star, ("system", "x"), ("user", "豆浆多少")).reason == "history"
    assert plan_of(spark, star, ("user", "x" * 1001), ("user", "豆浆多少")).reason == "history"
    earlier = [("system", "x"), *(("user", f"m{i}") for i in range(8))]
    assert plan_of(spark, star, *earlier, ("user", "豆浆多少")).status == "planned"


@pytest.mark.parametrize("block_turns", [1, 3, 10, 100_000])
def test_history_over_blocks_and_gaps(spark, block_turns):
    source = random.Random(block_turns)
    rows = [
        (conv, turn, "user", f"{conv}-{turn}")
        for conv, count in ((1, 40), (2, 1), (3, 9))
        for turn in sorted(source.sample(range(200), count))
    ]
    found = questions.with_history(spark.createDataFrame(rows, MESSAGE), block_turns).collect()
    assert len(found) == len(rows)
    for row in found:
        before = [text for conv, turn, _, text in rows if conv == row.conv_id and turn < row.turn]
        assert [message.text for message in row.history] == before[-8:]


def test_longest_product_against_brute_force(spark):
    source = random.Random(5)

    def word(low, high):
        return "".join(source.choice("ab 茶") for _ in range(source.randint(low, high)))

    names = {word(1, 5) for _ in range(25)} | {"", "a" * 130}
    products = [(f"P{i:02}", name) for i, name in enumerate(source.sample(sorted(names), len(names)))]
    products.append(("P99", products[0][1]))
    texts = [(i, word(0, 12)) for i in range(150)]
    texts += [(500, "b" * 127 + "a" * 130), (501, "b" * 100 + "a" * 129)]
    found = questions.longest_product(
        spark.createDataFrame(texts, "i int, text string"),
        spark.createDataFrame(products, "product_id string, product_name string"),
        "i",
    )
    rows = {row.i: row.product_name for row in found.collect()}
    for number, text in texts:
        inside = [(-len(name), key, name) for key, name in products if name and name in text]
        assert rows.get(number) == (min(inside)[2] if inside else None), text


@pytest.mark.parametrize(
    ("tool", "arguments", "status"),
    [
        ("get_revenue", {"start_date": "2026-05-01", "end_date": "2026-05-31"}, "ok"),
        ("get_revenue", {"start_date": "2026-05-01", "end_date": "2026-05-31", "store_id": None}, "ok"),
        ("get_revenue", {"start_date": "2026-05-01"}, "invalid arguments"),
        ("get_revenue", {"start_date": "2026-05-01", "end_date": "May"}, "invalid arguments"),
        ("get_revenue", {"start_date": "2026-05-01", "end_date": "2026-05-31", "city": "x"}, "invalid arguments"),
        ("get_revenue", {"start_date": "2026-05-02", "end_date": "2026-05-01"}, "start_date must not be after end_date"),
        ("get_top_entities", {"dimension": "store", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "ok"),
        ("get_top_entities", {"dimension": "city", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_top_entities", {"dimension": "store", "limit": 21, "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_top_entities", {"dimension": "store", "metric": "order_count", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_trend", {"metric": "order_count", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "ok"),
        ("get_trend", {"metric": "order_count", "granularity": "week", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_trend", {"metric": "profit", "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_trend", {"metric": "revenue", "filters": {"city": "x"}, "start_date": "2026-05-01", "end_date": "2026-05-31"}, "invalid arguments"),
        ("get_data_quality", {}, "ok"),
        ("get_data_quality", {"a": 1}, "invalid arguments"),
        ("run_sql", {"sql": "DROP TABLE sales"}, "unsupported tool: run_sql"),
        ("get_revenue", {"start_date": "2025-05-01", "end_date": "2025-05-31", "product_name": 5}, "invalid arguments"),
        ("get_trend", {"metric": "revenue", "filters": {"store_id": 7}, "start_date": "2025-05-01", "end_date": "2025-05-31"}, "invalid arguments"),
        ("get_trend", {"metric": "revenue", "filters": {"store_id": None}, "start_date": "2025-05-01", "end_date": "2025-05-31"}, "invalid arguments"),
        ("get_trend", {"metric": "revenue", "filters": [], "start_date": "2025-05-01", "end_date": "2025-05-31"}, "invalid arguments"),
        ("get_top_entities", {"dimension": "store", "limit": "5", "start_date": "2025-05-01", "end_date": "2025-05-31"}, "ok"),
        ("get_top_entities", {"dimension": "store", "limit": 5.0, "start_date": "2025-05-01", "end_date": "2025-05-31"}, "ok"),
        ("get_top_entities", {"dimension": "store", "limit": 5.5, "start_date": "2025-05-01", "end_date": "2025-05-31"}, "invalid arguments"),
        ("get_top_entities", {"dimension": 3, "start_date": "2025-05-01", "end_date": "2025-05-31"}, "invalid arguments"),
    ],
)
def test_argument_checks(spark, tool, arguments, status):
    calls = spark.createDataFrame([(tool, json.dumps(arguments))], "tool string, arguments string")
    row = tools.checked_calls(calls).first()
    reversed_range = status == "start_date must not be after end_date"
    assert row.call_status == ("ok" if reversed_range else status)


def test_all_tools_together(spark, star, quality_run):
    span = {"start_date": "2025-02-01", "end_date": "2025-04-30"}
    calls = {
        "trend": ("get_trend", {"metric": "revenue", **span, "filters": {"store_id": "n2"}}),
        "none": ("get_top_entities", {"dimension": "store", "start_date": "2020-01-01", "end_date": "2020-01-02"}),
        "back": ("get_revenue", {"start_date": "2026-05-02", "end_date": "2026-05-01"}),
        "flat": ("compare_periods", {"metric": "average_order_value", "current_start": "2020-01-01",
                 "current_end": "2020-01-02", "previous_start": "2019-01-01", "previous_end": "2019-01-02"}),
        "sql": ("run_sql", {"sql": "x"}),
    }
    frame = spark.createDataFrame(
        [(tool, json.dumps(arguments)) for tool, arguments in calls.values()] * 2,
        "tool string, arguments string",
    )
    rows = tools.run_tools(frame, star, quality_run).collect()
    assert len(rows) == len(calls)
    found = {name: next(r for r in rows if r.arguments == json.dumps(a)) for name, (_, a) in calls.items()}
    assert found["trend"].answer == "已查询 2 个日度数据点，可在趋势图中查看。"
    assert json.loads(found["trend"].result)["points"] == [
        {"date": "2025-03-09", "value": 400}, {"date": "2025-04-30", "value": 600000},
    ]
    assert found["trend"].action.store_id == "n2"
    assert found["none"].answer == fixed.NO_RANKING_TEXT
    assert json.loads(found["none"].parameters)["limit"] == 10
    assert found["back"].status == "start_date must not be after end_date" and found["back"].answer is None
    assert found["flat"].answer == "最近一个完整月的客单价为 暂无数据，相比上月持平，缺少可用基线。"
    assert found["sql"].status == "unsupported tool: run_sql" and found["sql"].result is None


def test_names_in_texts_and_across_seams_against_brute_force(spark):
    source = random.Random(9)
    names = ["ab", "a b", "b a b", "ba ab a", " a", "b ", "a", "ab ba ab ab", "豆 浆", "浆", "zz"]
    products = [(f"D{source.randrange(99):02d}{i}", name, "c", 1) for i, name in enumerate(names)]
    products += [("D000", "a b", "c", 1), ("D99", "", "c", 1)]
    word = lambda: "".join(source.choices(["a", "b", "ab", " ", "豆", "浆", "x"], k=source.randrange(5)))
    rows = [(i, i % 3, [word() for _ in range(source.randrange(9))], word() or "x") for i in range(150)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, said array<string>, current string")
    table = spark.createDataFrame(products, "product_id string, product_name string, product_category string, unit_price_cents long")
    found = {(r.conv_id, r.turn): r.product_name for r in questions.product_in_context(frame, table).collect()}
    for conv, turn, said, current in rows:
        text = " ".join(said) + " " + current
        inside = sorted((-len(n), min(p for p, x, *_ in products if x == n), n) for n in names if n in text)
        assert found.get((conv, turn)) == (inside[0][2] if inside else None), (said, current)
    assert questions.product_in_context(frame, table.where("false")).count() == 0


def test_tools_share_a_pass_and_do_not_meet_in_one_plan(spark, small_star, quality_run, monkeypatch):
    """Revenue and comparisons read the facts once; the last plan joins written evidence only."""
    made = []

    class Counted(batch._Asked):
        def __init__(self, *given, **named):
            made.append(given)
            super().__init__(*given, **named)

    monkeypatch.setattr(batch, "_Asked", Counted)
    span = '"start_date":"2025-09-09","end_date":"2025-09-11"'
    pair = '"current_start":"2025-09-10","current_end":"2025-09-11","previous_start":"2025-08-20","previous_end":"2025-09-09"'
    calls = [
        ("get_revenue", "{%s}" % span),
        ("compare_periods", '{"metric":"revenue",%s}' % pair),
        ("get_data_quality", "{}"),
    ]
    found = tools.run_tools(spark.createDataFrame(calls, "tool string, arguments string"), small_star, quality_run)
    assert len(made) == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    rows = {row.tool: row for row in found.collect()}
    assert json.loads(rows["get_revenue"].result) == {"revenue_cents": 8800, "order_count": 5, "average_order_value_cents": 1760}
    compared = json.loads(rows["compare_periods"].result)
    assert (compared["current_value"], compared["previous_value"]) == (7600, 1600)
    assert rows["get_data_quality"].status == "ok"


def test_trends_share_the_pass_over_the_facts(spark, small_star, quality_run, monkeypatch):
    """Revenue, comparisons and trends read the facts once, whatever their filters; reversed ranges ask for nothing."""
    made = []

    class Counted(batch._Asked):
        def __init__(self, *given, **named):
            made.append(given)
            super().__init__(*given, **named)

    monkeypatch.setattr(batch, "_Asked", Counted)
    span = '"start_date":"2025-09-09","end_date":"2025-09-11"'
    calls = [
        ("get_revenue", '{%s,"store_id":"n1"}' % span),
        ("get_trend", '{"metric":"order_count",%s,"filters":{"product_name":"豆浆"}}' % span),
        ("get_trend", '{"metric":"revenue","start_date":"2025-08-01","end_date":"2025-09-10"}'),
        ("get_trend", '{"metric":"revenue","start_date":"2025-09-11","end_date":"2025-09-09"}'),
    ]
    found = tools.run_tools(spark.createDataFrame(calls, "tool string, arguments string"), small_star, quality_run).collect()
    assert len(made) == 1
    got = {row.arguments: row.result and json.loads(row.result) for row in found}
    assert got[calls[0][1]] == {"revenue_cents": 4800, "order_count": 2, "average_order_value_cents": 2400}
    assert got[calls[1][1]]["points"] == [{"date": "2025-09-10", "value": 1}, {"date": "2025-09-11", "value": 2}]
    assert got[calls[2][1]]["points"] == [
        {"date": "2025-08-20", "value": 400}, {"date": "2025-09-09", "value": 1200}, {"date": "2025-09-10", "value": 4400}
    ]
    assert got[calls[3][1]] is None
