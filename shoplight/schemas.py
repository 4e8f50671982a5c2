"""Declared schemas of the analytics and shop tables.

Times are written as TIMESTAMP (UTC instants) because watermarks need that type; the batch
operators accept TIMESTAMP and TIMESTAMP_NTZ alike. Unsigned integers of the stored
layout map to the next wider signed type.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, MapType, ShortType,
    StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

_TYPES: dict[str, DataType] = {
    "string": StringType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(),
    "timestamp_ntz": TimestampNTZType(),
    "double": DoubleType(), "smallint": ShortType(), "int": IntegerType(), "bigint": LongType(),
    "decimal(10,2)": DecimalType(10, 2), "decimal(3,2)": DecimalType(3, 2),
    "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType()),
}


def _schema(columns: str) -> StructType:
    """A schema from ``"name type, name type not null, ..."``; needs no running session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *required = column.split(" ")
        fields.append(StructField(name, _TYPES[kind], nullable=not required))
    return StructType(fields)


# The names and types of stored columns.
EVENT_TABLES = {
    "user_sessions": _schema(
        "session_id string not null, user_id string, ip_address string, user_agent string, device_type string, "
        "browser string, operating_system string, country string, city string, session_start_time timestamp not null, "
        "session_end_time timestamp, page_views bigint, session_duration_seconds bigint, referrer_source string, "
        "utm_campaign string, utm_medium string, utm_source string, created_at timestamp"
    ),
    "page_views": _schema(
        "event_id string not null, session_id string not null, user_id string, page_url string, page_title string, "
        "page_category string, timestamp timestamp not null, time_on_page_seconds bigint, scroll_depth_percentage smallint, "
        "exit_page boolean, bounce boolean, previous_page string, referrer string, created_at timestamp"
    ),
    "game_interactions": _schema(
        "event_id string not null, session_id string not null, user_id string, game_id bigint, game_title string, "
        "game_category string, event_type string, event_data string, timestamp timestamp not null, page_context string, "
        "created_at timestamp"
    ),
    "purchase_events": _schema(
        "event_id string not null, session_id string not null, user_id string, order_id string, customer_id string, "
        "game_id bigint, game_title string, game_category string, quantity int, unit_price decimal(10,2), "
        "discount_amount decimal(10,2), total_amount decimal(10,2), payment_method string, "
        "purchase_timestamp timestamp not null, funnel_step string, conversion_time_seconds bigint, created_at timestamp"
    ),
    "search_events": _schema(
        "event_id string not null, session_id string not null, user_id string, search_query string, search_category string, "
        "results_count bigint, clicked_result_position int, clicked_game_id bigint, no_results boolean, "
        "timestamp timestamp not null, created_at timestamp"
    ),
    "performance_metrics": _schema(
        "metric_id string not null, service_name string, metric_type string, metric_value double, unit string, "
        "endpoint string, status_code int, error_message string, timestamp timestamp not null, created_at timestamp"
    ),
    "user_behavior_flow": _schema(
        "flow_id string not null, session_id string not null, user_id string, step_number smallint, page_url string, "
        "action_type string, element_clicked string, timestamp timestamp not null, "
        "time_since_previous_step_seconds bigint, created_at timestamp"
    ),
}

SHOP_TABLES = {
    "games": _schema(
        "id int, game_id string not null, name string, description string, price decimal(10,2), "
        "discount_price decimal(10,2), category string, tags array<string>, image_url string, release_date date, "
        "rating decimal(3,2), is_featured boolean, is_trending boolean, stock_quantity int, developer string, "
        "publisher string, platform string, system_requirements string, created_at timestamp, updated_at timestamp"
    ),
    "game_categories": _schema("id int, name string not null, description string, created_at timestamp"),
    "game_reviews": _schema(
        "id int, review_id string, game_id string, user_id string, rating int, review_text string, "
        "is_verified_purchase boolean, created_at timestamp, updated_at timestamp"
    ),
    "customers": _schema(
        "id int, customer_id string not null, first_name string, last_name string, email string, phone string, "
        "date_of_birth date, created_at timestamp, updated_at timestamp"
    ),
    "customer_addresses": _schema(
        "id int, address_id string, customer_id string, address_type string, first_name string, last_name string, "
        "company string, address_line_1 string, address_line_2 string, city string, state_province string, "
        "postal_code string, country string, is_default boolean, created_at timestamp, updated_at timestamp"
    ),
    "orders": _schema(
        "id int, order_id string not null, customer_id string, order_status string, total_amount decimal(10,2), "
        "subtotal decimal(10,2), tax_amount decimal(10,2), shipping_cost decimal(10,2), discount_amount decimal(10,2), "
        "payment_method string, payment_status string, shipping_address_id string, billing_address_id string, "
        "order_notes string, estimated_delivery date, actual_delivery date, tracking_number string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "order_items": _schema(
        "id int, order_id string, game_id string, game_name string, quantity int, unit_price decimal(10,2), "
        "discount_price decimal(10,2), total_price decimal(10,2), created_at timestamp"
    ),
    "order_status_history": _schema(
        "id int, order_id string, previous_status string, new_status string, status_reason string, changed_by string, "
        "created_at timestamp"
    ),
}

# Older event layout: integer user ids, ``amount`` and ``response_time`` columns.
LEGACY_TABLES = {
    "user_events": _schema(
        "timestamp timestamp, user_id bigint, event_type string, page_url string, session_id string, ip_address string, "
        "user_agent string, metadata string"
    ),
    "game_events": _schema("timestamp timestamp, user_id bigint, game_id bigint, event_type string, metadata string"),
    "purchase_events": _schema(
        "timestamp timestamp, user_id bigint, order_id bigint, game_id bigint, amount decimal(10,2), currency string, "
        "payment_method string, status string"
    ),
    "performance_metrics": _schema(
        "timestamp timestamp, service_name string, endpoint string, response_time bigint, status_code int, "
        "error_message string"
    ),
}

# Rows of a batch envelope: the union of the fields that the four event kinds use.
ENVELOPE_EVENT = _schema(
    "event_type string, event_id string, session_id string, user_id string, timestamp string, page_url string, "
    "page_title string, page_category string, time_on_page_seconds bigint, scroll_depth_percentage int, "
    "exit_page boolean, bounce boolean, previous_page string, referrer string, game_id bigint, game_title string, "
    "game_category string, interaction_type string, event_data string, page_context string, "
    "search_query string, search_category string, results_count bigint, clicked_result_position int, "
    "clicked_game_id bigint, no_results boolean, service_name string, metric_type string, metric_value double, "
    "unit string, endpoint string, status_code int, error_message string"
)

# All values as texts: what does not fit its type is told apart from what is missing.
ENVELOPE_TEXTS = StructType([StructField(f.name, StringType()) for f in ENVELOPE_EVENT.fields])

SINGLE_EVENT = _schema(
    "eventType string, event_type string, userId string, user_id string, gameId string, game_id string, "
    "sessionId string, session_id string, eventId string, event_id string, timestamp string, "
    "metadata map<string,string>"
)

# The generic tables that the logical shop tables are derived from.
RAW_TABLES = {
    "events": _schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    "orders": _schema(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": _schema(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "part": _schema(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "customer": _schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "region": _schema("r_regionkey int, r_name string"),
    "pages": _schema("page_id bigint, url string, html string"),
}

# The columns that each event table is sorted by.
SORT_KEYS = {
    "user_sessions": ("session_start_time", "session_id"),
    "page_views": ("timestamp", "session_id"),
    "game_interactions": ("timestamp", "game_id", "event_type"),
    "purchase_events": ("purchase_timestamp", "customer_id", "game_id"),
    "search_events": ("timestamp", "search_query"),
    "performance_metrics": ("timestamp", "service_name", "metric_type"),
    "user_behavior_flow": ("session_id", "step_number", "timestamp"),
}

# Event-time columns. A table's partition column ``event_date`` is always the date of its event time.
EVENT_TIMES = ("timestamp", "purchase_timestamp", "session_start_time")

# Allowed values of constrained columns.
ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled")
PAYMENT_METHODS = ("credit_card", "debit_card", "paypal", "bank_transfer")
PAYMENT_STATUSES = ("pending", "paid", "failed", "refunded")
ADDRESS_TYPES = ("billing", "shipping")

# How long each table keeps its rows, and the column that ages.
RETENTION = {
    "user_sessions": ("2 YEAR", "created_at"),
    "page_views": ("1 YEAR", "created_at"),
    "game_interactions": ("1 YEAR", "created_at"),
    "purchase_events": ("3 YEAR", "created_at"),
    "search_events": ("1 YEAR", "created_at"),
    "performance_metrics": ("6 MONTH", "created_at"),
    "user_behavior_flow": ("1 YEAR", "created_at"),
    "legacy_user_events": ("1 YEAR", "timestamp"),
    "legacy_game_events": ("2 YEAR", "timestamp"),
    "legacy_purchase_events": ("7 YEAR", "timestamp"),
    "legacy_performance_metrics": ("30 DAY", "timestamp"),
}
