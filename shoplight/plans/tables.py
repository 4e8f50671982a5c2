"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from shoplight.operators.traffic import export_page_views
from shoplight.plans.registry import query
from shoplight.schemas import SORT_KEYS
from shoplight.session import work_dir
from shoplight.sources.rows import read_event_rows, upgrade_layout
from shoplight.sources.shop_views import ShopViews
from shoplight.sources.sinks import append_batches, export_csv, to_json_rows
from shoplight.sources.tables import table_counts

# The given tables and, of the declared ones, those that the test data fill.
_GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")
_DECLARED = {
    "page_views": "page_views", "game_interactions": "game_interactions", "purchase_events": "purchase_events",
    "search_events": "search_events", "performance_metrics": "performance_metrics", "user_sessions": "user_sessions",
    "games": "games", "order_items": "order_items", "customers": "customers", "customer_addresses": "customer_addresses",
    "game_reviews": "game_reviews",
}


@query("src_table_counts", "\nUNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _GIVEN]
    + [f"SELECT 'declared {name}', count(*) FROM {view}" for name, view in _DECLARED.items()]
    + ["SELECT 'declared orders', count(*) FROM shop_orders"]))
def src_table_counts(v: ShopViews) -> DataFrame:
    """Every given table, and the declared tables as a shop would have them."""
    given = {name: v.spark.read.parquet(f"{v.root}/{name}.parquet") for name in _GIVEN}
    declared = {f"declared {name}": getattr(v, name) for name in [*_DECLARED, "orders"]}
    return table_counts({**given, **declared})


@query("src_json_rows", """
SELECT user_id, kind AS event_type, count(*) AS row_count, CAST(sum(k) AS BIGINT) AS k_sum, max(timestamp) AS newest
FROM ev GROUP BY user_id, kind""")
def src_json_rows(v: ShopViews) -> DataFrame:
    path = work_dir(v.spark, "json-rows")
    rows = v.ev.select("event_id", "user_id", "timestamp", "kind", "k")
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    schema = StructType([
        StructField("event_id", StringType()), StructField("user_id", StringType()),
        StructField("timestamp", TimestampNTZType()), StructField("kind", StringType()), StructField("k", LongType()),
    ])
    rows = read_event_rows(v.spark, path, schema).filter(F.col("_corrupt_record").isNull())
    return rows.groupBy("user_id", F.col("kind").alias("event_type")).agg(
        F.count("*").alias("row_count"), F.sum("k").alias("k_sum"), F.max("timestamp").alias("newest")
    )


@query("src_legacy_layout", """
SELECT CAST(user_no AS VARCHAR) AS user_id, 'response_time' AS metric_type, CAST(k AS DOUBLE) AS metric_value,
       'ms' AS unit, 200 + k % 5 AS status_code, timestamp
FROM ev""")
def src_legacy_layout(v: ShopViews) -> DataFrame:
    legacy = v.ev.select(
        "timestamp", F.col("user_no").cast("string").alias("service_name"), F.lit("/").alias("endpoint"),
        F.col("k").alias("response_time"), (F.col("k") % 5 + 200).alias("status_code"),
        F.lit(None).cast("string").alias("error_message"),
    )
    rows = upgrade_layout(legacy, "performance_metrics")
    return rows.select(
        F.col("service_name").alias("user_id"), "metric_type", "metric_value", "unit", "status_code", "timestamp"
    )


@query("src_legacy_purchases", """
SELECT user_id, event_id AS order_id, game_id, 1 AS quantity, CAST(total_amount AS DOUBLE) AS total_amount,
       CASE game_id % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency,
       purchase_timestamp, 'purchase' AS funnel_step, status
FROM purchase_events""")
def src_legacy_purchases(v: ShopViews) -> DataFrame:
    legacy = v.purchase_events.select(
        F.col("purchase_timestamp").alias("timestamp"), F.col("user_id").cast("bigint").alias("user_id"),
        F.col("event_id").cast("bigint").alias("order_id"), "game_id", F.col("total_amount").alias("amount"),
        _currency().alias("currency"), "payment_method", "status",
    )
    return upgrade_layout(legacy, "purchase_events").drop("payment_method")


def _currency() -> Column:
    return F.when(F.col("game_id") % 2 == 0, "USD").otherwise("EUR")


@query("src_legacy_revenue", """
SELECT CASE game_id % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(sum(total_amount) AS DOUBLE) AS revenue, count(*) AS purchases
FROM purchase_events GROUP BY 1""")
def src_legacy_revenue(v: ShopViews) -> DataFrame:
    """Amounts of different currencies do not add up."""
    rows = upgrade_layout(v.purchase_events.select(
        F.col("purchase_timestamp").alias("timestamp"), "user_id", "order_id", "game_id", F.col("total_amount").alias("amount"),
        _currency().alias("currency"), "payment_method", "status"), "purchase_events")
    return rows.groupBy("currency").agg(F.sum("total_amount").alias("revenue"), F.count("*").alias("purchases"))


@query("src_legacy_user_events", """
SELECT session_id, user_id, '/' || k AS page_url, kind AS action_type, props AS event_data, timestamp,
       '10.0.0.' || k % 250 AS ip_address, 'browser ' || k % 3 AS user_agent
FROM ev""")
def src_legacy_user_events(v: ShopViews) -> DataFrame:
    return upgrade_layout(v.ev.select(
        F.col("user_no").alias("user_id"), "session_id", F.col("kind").alias("event_type"), F.concat(F.lit("/"), "k").alias("page_url"),
        F.concat(F.lit("browser "), F.col("k") % 3).alias("user_agent"), F.concat(F.lit("10.0.0."), F.col("k") % 250).alias("ip_address"),
        "timestamp", F.col("props").alias("metadata")), "user_events")


@query("src_legacy_game_events", """
SELECT user_id, game_id, event_type, props AS event_data, timestamp FROM game_events""")
def src_legacy_game_events(v: ShopViews) -> DataFrame:
    return upgrade_layout(v.game_interactions.select(
        "user_id", "game_id", "event_type", "timestamp", F.col("event_data").alias("metadata")), "game_events")


@query("snk_append_counts", """
SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS row_count,
       (SELECT count(*) FROM page_views) AS rows_written
FROM page_views GROUP BY 1""")
def snk_append_counts(v: ShopViews) -> DataFrame:
    path = work_dir(v.spark, "append")
    receipt = append_batches(v.page_views, path, sort_by=SORT_KEYS["page_views"])
    return v.spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("row_count")).select(
        "*", F.lit(receipt["rows"]).cast("bigint").alias("rows_written"),
    )


@query("snk_csv_roundtrip", """
SELECT CAST(timestamp AS DATE) AS date, page_category, count(*) AS page_views,
       count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users
FROM page_views WHERE timestamp >= {as_of} - INTERVAL 30 DAY GROUP BY 1, 2""")
def snk_csv_roundtrip(v: ShopViews) -> DataFrame:
    as_of = v.newest_event_value()
    export = export_page_views(v.page_views, as_of=as_of).select(
        "date", "page_category", "page_views", "unique_sessions", "unique_users"
    )
    path = export_csv(export, work_dir(v.spark, "export"), "page_views", as_of.date())
    return v.spark.read.schema(export.schema).csv(path)


@query("snk_json_rows", """
SELECT CAST(game_id AS VARCHAR) AS game_id, name, CAST(rating AS DOUBLE) AS rating,
       CAST(discount_price AS DOUBLE) AS discount_price
FROM games""")
def snk_json_rows(v: ShopViews) -> DataFrame:
    rows = to_json_rows(v.games.select("game_id", "name", "rating", "discount_price"))
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.select(
        field("game_id").alias("game_id"), field("name").alias("name"), field("rating").cast("double").alias("rating"),
        field("discount_price").cast("double").alias("discount_price"),
    )
