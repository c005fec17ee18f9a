"""Declared schemas of the published tables."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerlark.fixed import SALES_FIELDS


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TEXT, WHOLE = T.StringType(), T.LongType()

RAW_RECORD = _struct(*((name, TEXT) for name in SALES_FIELDS))

RAW_SALES = _struct(
    ("source_file", TEXT),
    ("split_start", WHOLE),
    ("read_order", WHOLE),
    *((name, TEXT) for name in SALES_FIELDS),
)

RAW_SPLITS = _struct(
    ("source_file", TEXT),
    ("split_start", WHOLE),
    ("first_read_order", WHOLE),
    ("rows_before", WHOLE),
)

STORES = _struct(
    ("store_id", TEXT), ("store_name", TEXT), ("category", TEXT), ("district", TEXT)
)

PRODUCTS = _struct(
    ("product_id", TEXT),
    ("product_name", TEXT),
    ("product_category", TEXT),
    ("unit_price_cents", WHOLE),
)

# One written table holds the outcome of every distinct source row.  Trusted
# facts and quarantine are its two partitions.
OUTCOMES = _struct(
    ("row_number", WHOLE),
    ("order_id", TEXT),
    ("store_id", TEXT),
    ("product_id", TEXT),
    ("qty", WHOLE),
    ("amount_cents", WHOLE),
    ("amount_source", TEXT),
    ("payment", TEXT),
    ("copies_removed", WHOLE),
    ("is_imputed", T.BooleanType()),
    ("reasons", T.ArrayType(TEXT)),
    ("raw_json", TEXT),
    ("outcome", TEXT),
    ("date", T.DateType()),
)

# Steps of orders by variant; the last column is a partition.
ROLLUPS = _struct(
    ("store_id", TEXT),
    ("product_id", TEXT),
    ("previous_date", T.DateType()),
    ("date", T.DateType()),
    ("amount_cents", WHOLE),
    ("qty", WHOLE),
    ("facts", WHOLE),
    ("orders", WHOLE),
    ("variant", TEXT),
)

SUMMARY = _struct(
    ("source_hash", TEXT),
    ("raw_sales", WHOLE),
    ("duplicate_rows_removed", WHOLE),
    ("amounts_imputed", WHOLE),
    ("valid_sales", WHOLE),
    ("quarantined_sales", WHOLE),
    ("date_min", T.DateType()),
    ("date_max", T.DateType()),
    ("issue_counts", T.MapType(TEXT, WHOLE)),
)

# A run's number is in the name of the file that publishes it.
PUBLISHED_RUNS = _struct(
    ("folder", TEXT),
    ("source_hash", TEXT),
    ("rule_version", TEXT),
    ("started_at", T.TimestampNTZType()),
    ("completed_at", T.TimestampNTZType()),
    ("summary_json", TEXT),
)

# Warehouse tables, as DDL.
WAREHOUSE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
