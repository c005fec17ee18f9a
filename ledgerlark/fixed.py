"""Words, codes, formats and limits that decide results.

Everything here is data.  The code that uses it lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: input columns -------------------------------------------
SALES_FIELDS = ("order_id", "date", "store_id", "product_id", "qty", "amount", "payment")
STORE_FIELDS = ("store_id", "store_name", "category", "district")
PRODUCT_FIELDS = ("product_id", "product_name", "product_category", "unit_price")
REQUIRED_FILES = ("stores.csv", "products.csv", "sales.csv")

# --- fixed values: cleaning -------------------------------------------------
# The version of this engine's own rules.
RULE_VERSION = "ledgerlark-2"
CURRENCY_SIGN = "¥"
# Every character Unicode calls white space, so padded cells compare equal.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# (shape of the text, Spark date pattern)
DATE_SHAPES = (
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
)
INTEGER_SHAPE = "^[+-]?[0-9]+$"
DECIMAL_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
REASON_CODES = (
    "amount_unit_price_mismatch",
    "invalid_amount",
    "invalid_date",
    "invalid_quantity",
    "missing_amount",
    "quantity_amount_sign_conflict",
    "unknown_product",
    "unknown_store",
    "zero_quantity_nonzero_amount",
    "zero_value_transaction",
)

# --- fixed values: metrics --------------------------------------------------
METRICS = ("revenue", "order_count", "average_order_value")
DIMENSIONS = ("store_category", "store", "product", "product_category")
TOP_PRODUCT_COUNT = 10
MAX_TOP_LIMIT = 20
ALL_DATA_LABEL = "全部数据"

# --- fixed values: questions ------------------------------------------------
MONTH_LABELS = (
    "一月", "二月", "三月", "四月", "五月", "六月",
    "七月", "八月", "九月", "十月", "十一月", "十二月",
)
QUALITY_WORDS = ("数据质量", "质量问题", "脏数据")
ORDER_VALUE_WORD = "客单价"
CHANGE_WORDS = ("涨", "跌", "趋势", "最近")
CATEGORY_WORD = "品类"
RANKING_WORDS = ("最高", "最多", "第一", "哪个")
STORE_WORD = "门店"
AMOUNT_WORDS = ("多少", "营业额", "卖了", "销售")
FOLLOW_UP_WORD = "呢"
MAX_QUESTION_CHARS = 500
MAX_MESSAGE_CHARS = 1000
MAX_HISTORY = 8
CHAT_ROLES = ("user", "assistant")
TOOLS = ("get_revenue", "get_top_entities", "compare_periods", "get_trend", "get_data_quality")

NO_DATES_TEXT = "当前数据库没有可查询的销售日期。"
OUT_OF_SCOPE_TEXT = "这个问题超出了当前销售数据可以回答的范围。"
UNAVAILABLE_TEXT = "查询暂时不可用。看板仍可正常使用，请稍后重试。"
NO_MONEY_TEXT = "暂无数据"
NO_RANKING_TEXT = "所选范围内没有可排名的数据。"
NO_BASELINE_TEXT = "，缺少可用基线"
ANY_SUBJECT_TEXT = "所选范围"
DIRECTION_WORDS = (("up", "上涨"), ("down", "下降"), ("flat", "持平"))
# Answer sentences; %s marks the values put in, in order.
REVENUE_SENTENCE = "%s在 %s 至 %s 的营业额为 %s，覆盖 %s 个订单。"
RANKING_SENTENCE = "营业额最高的是“%s”，营业额为 %s。"
COMPARISON_SENTENCE = "最近一个完整月的客单价为 %s，相比上月%s%s。"
TREND_SENTENCE = "已查询 %s 个日度数据点，可在趋势图中查看。"
QUALITY_SENTENCE = "原始数据 %s 行，清洗后有效 %s 行，隔离 %s 行。"
