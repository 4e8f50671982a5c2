"""Data-quality rules and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.operators import orders, quality, retention
from shoplight.plans.registry import query
from shoplight.schemas import ADDRESS_TYPES, EVENT_TABLES, PAYMENT_METHODS
from shoplight.session import work_dir
from shoplight.sources.shop_views import ShopViews
from shoplight.streaming.intake import route_batch


@query("dq_not_null", """
SELECT 'not_null:order_id' AS rule, count(*) AS checked_rows, count(*) FILTER (WHERE order_id IS NULL) AS violations FROM shop_orders
UNION ALL SELECT 'not_null:total_amount', count(*), count(*) FILTER (WHERE total_amount IS NULL) FROM shop_orders
UNION ALL SELECT 'not_null:shipping_address_id', count(*), count(*) FILTER (WHERE shipping_address_id IS NULL) FROM shop_orders
UNION ALL SELECT 'not_null:discount_price', count(*), count(*) FILTER (WHERE discount_price IS NULL) FROM order_items""")
def dq_not_null(v: ShopViews) -> DataFrame:
    return quality.check_not_null(v.orders, ["order_id", "total_amount", "shipping_address_id"]).unionAll(
        quality.check_not_null(v.order_items, ["discount_price"])
    )


def _unique_sql(label: str, columns: str, table: str) -> str:
    return f"""SELECT 'unique:{label}' AS rule, CAST(sum(n) AS BIGINT) AS checked_rows,
       count(*) FILTER (WHERE n > 1 AND given) AS repeated_keys, CAST(sum(CASE WHEN given THEN n - 1 ELSE 0 END) AS BIGINT) AS violations
FROM (SELECT count(*) AS n, {' AND '.join(f'{c} IS NOT NULL' for c in columns.split(', '))} AS given FROM {table} GROUP BY {columns})"""


@query("dq_unique", "\nUNION ALL\n".join([
    _unique_sql("game_id", "game_id", "games"), _unique_sql("customer_id", "customer_id", "customers"),
    _unique_sql("email", "email", "customers"), _unique_sql("review_id", "review_id", "game_reviews"),
    _unique_sql("user_id,game_id", "user_id, game_id", "game_reviews"),
    _unique_sql("shipping_address_id", "shipping_address_id", "shop_orders"),
]))
def dq_unique(v: ShopViews) -> DataFrame:
    checks = [
        (v.games, ["game_id"]), (v.customers, ["customer_id"]), (v.customers, ["email"]),
        (v.game_reviews, ["review_id"]), (v.game_reviews, ["user_id", "game_id"]),
        (v.orders, ["shipping_address_id"]),
    ]
    first, *rest = [quality.check_unique(df, key) for df, key in checks]
    for report in rest:
        first = first.unionAll(report)
    return first


def _fk_sql(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT 'foreign_key:{key}' AS rule, count(*) AS orphan_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations
FROM (SELECT {key} AS key, count(*) AS n FROM {child} WHERE {key} IS NOT NULL GROUP BY 1) c
WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {parent}.{parent_key} = c.key)"""


@query("dq_foreign_key", "\nUNION ALL\n".join([
    _fk_sql("order_items", "order_id", "shop_orders", "order_id"), _fk_sql("order_items", "game_id", "games", "game_id"),
    _fk_sql("shop_orders", "customer_id", "customers", "customer_id"),
    _fk_sql("shop_orders", "shipping_address_id", "customer_addresses", "address_id"),
    _fk_sql("search_events", "results_count", "search_events", "clicked_result_position"),
]))
def dq_foreign_key(v: ShopViews) -> DataFrame:
    checks = [
        (v.order_items, v.orders, "order_id", "order_id"), (v.order_items, v.games, "game_id", "game_id"),
        (v.orders, v.customers, "customer_id", "customer_id"),
        (v.orders, v.customer_addresses, "shipping_address_id", "address_id"),
        # No relation of the shop: it has orphans, which the others should not.
        (v.search_events, v.search_events, "results_count", "clicked_result_position"),
    ]
    return quality.check_fks(checks)


@query("dq_domain", """
SELECT 'domain:order_status' AS rule, count(*) AS checked_rows,
       count(*) FILTER (WHERE order_status NOT IN ('pending', 'confirmed', 'cancelled')) AS violations FROM shop_orders
UNION ALL SELECT 'domain:payment_method', count(*),
       count(*) FILTER (WHERE payment_method NOT IN ('credit_card', 'debit_card', 'paypal', 'bank_transfer')) FROM shop_orders
UNION ALL SELECT 'domain:payment_status', count(*),
       count(*) FILTER (WHERE payment_status NOT IN ('pending', 'paid')) FROM shop_orders
UNION ALL SELECT 'domain:address_type', count(*),
       count(*) FILTER (WHERE address_type NOT IN ('billing', 'shipping')) FROM customer_addresses""")
def dq_domain(v: ShopViews) -> DataFrame:
    rules = {
        "order_status": ("pending", "confirmed", "cancelled"), "payment_method": PAYMENT_METHODS,
        "payment_status": ("pending", "paid"),
    }
    return quality.check_domain(v.orders, rules).unionAll(
        quality.check_domain(v.customer_addresses, {"address_type": ADDRESS_TYPES})
    )


@query("dq_range", """
SELECT 'range:rating' AS rule, count(*) AS checked_rows, count(*) FILTER (WHERE rating < 1 OR rating > 5) AS violations FROM game_reviews
UNION ALL SELECT 'range:rating', count(*), count(*) FILTER (WHERE rating < 2 OR rating > 5) FROM games""")
def dq_range(v: ShopViews) -> DataFrame:
    return quality.check_range(v.game_reviews, {"rating": (1, 5)}).unionAll(
        quality.check_range(v.games, {"rating": (2, 5)})
    )


@query("dq_order_totals", """
SELECT rule, count(*) AS checked_rows, count(*) FILTER (WHERE broken) AS violations
FROM (SELECT o.order_id, o.total_amount <> p.subtotal + p.tax_amount + p.shipping_cost AS wrong_parts,
             l.lines IS DISTINCT FROM p.subtotal AS wrong_lines
      FROM priced_orders p JOIN shop_orders o ON o.order_id = p.order_id
      LEFT JOIN (SELECT order_id, sum(coalesce(nullif(discount_price, 0), unit_price) * quantity) AS lines
                 FROM order_items GROUP BY order_id) l ON l.order_id = p.order_id)
CROSS JOIN LATERAL (VALUES ('total:parts', wrong_parts), ('total:lines', wrong_lines)) r(rule, broken)
GROUP BY rule""")
def dq_order_totals(v: ShopViews) -> DataFrame:
    priced = orders.price_orders(v.order_items, dt.date(2024, 1, 31)).drop("total_amount")
    stated = priced.join(v.orders.select("order_id", "total_amount"), "order_id")
    return quality.check_order_totals(stated, orders.price_lines(v.order_items))


def _aged_sql(table: str, source: str, time: str, length: str, as_of: str, name: str | None = None) -> str:
    return f"""
SELECT '{name or table}' AS table_name, count(*) FILTER (WHERE {time} + INTERVAL {length} > TIMESTAMP '{as_of}') AS kept_rows,
       count(*) FILTER (WHERE {time} + INTERVAL {length} <= TIMESTAMP '{as_of}') AS dropped_rows,
       count(*) FILTER (WHERE {time} IS NULL) AS unknown_rows
FROM {source}"""


# Two batches of the intake, received on different days; the events' own times do not matter.
_RECEIVED = (dt.datetime(2024, 3, 1), dt.datetime(2024, 5, 31, 12))
_STORED = """(SELECT CASE floor(event_no / 50) % 2 WHEN 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-05-31 12:00:00' END AS created_at
              FROM envelope_events WHERE event_type = '{}')"""
_INTAKE = {"page_views": ("page_view", "1 YEAR", dt.datetime(2025, 4, 1)), "search_events": ("search", "1 YEAR", dt.datetime(2025, 3, 1)),
           "performance_metrics": ("performance", "6 MONTH", dt.datetime(2024, 11, 30, 12))}


@query("str_retention", "\nUNION ALL".join([
    _aged_sql("legacy_performance_metrics", "performance_metrics", "timestamp", "30 DAY", "2024-02-10 00:00:00"),
    _aged_sql("performance_metrics", "performance_metrics", "CASE WHEN CAST(metric_id AS BIGINT) % 5 <> 0 THEN timestamp END", "6 MONTH",
              "2024-07-15 00:00:00"),
    _aged_sql("purchase_events", "purchase_events", "purchase_timestamp", "3 YEAR", "2027-01-05 00:00:00"),
]))
def str_retention(v: ShopViews) -> DataFrame:
    report = retention.retention_report
    some = v.performance_metrics.withColumn("timestamp", F.when(F.col("metric_id").cast("bigint") % 5 != 0, F.col("timestamp")))
    return (
        report(v.performance_metrics, "legacy_performance_metrics", dt.datetime(2024, 2, 10), "timestamp")
        .unionAll(report(some, "performance_metrics", dt.datetime(2024, 7, 15), "timestamp"))
        .unionAll(report(v.purchase_events, "purchase_events", dt.datetime(2027, 1, 5), "purchase_timestamp"))
    )


@query("str_expiry", """
SELECT CAST(timestamp AS DATE) AS day, count(*) AS row_count FROM performance_metrics
WHERE timestamp + INTERVAL 6 MONTH > TIMESTAMP '2024-07-15 10:30:00' OR timestamp IS NULL GROUP BY 1""")
def str_expiry(v: ShopViews) -> DataFrame:
    """What is left of a dated table after its expired days' folders are removed and its border day is written anew."""
    path = work_dir(v.spark, "expiry")
    retention.write_dated(v.performance_metrics, "performance_metrics", path, "timestamp")
    retention.expire(v.spark, path, "performance_metrics", dt.datetime(2024, 7, 15, 10, 30), "timestamp")
    return v.spark.read.parquet(path).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("row_count"))


@query("str_retention_intake", "\nUNION ALL".join(
    _aged_sql(table, _STORED.format(kind), "created_at", length, as_of.isoformat(" ")) for table, (kind, length, as_of) in _INTAKE.items()))
def str_retention_intake(v: ShopViews) -> DataFrame:
    """Tables as the intake writes them, read with their declared schemas, by their own insert time."""
    root = work_dir(v.spark, "retention")
    bodies = v.batch_envelopes.filter("body_no >= 0")
    for i, received in enumerate(_RECEIVED):
        route_batch(bodies.filter(F.col("body_no") % 2 == i).select("body"), root, i, received)
    found = [
        retention.retention_report(v.spark.read.schema(EVENT_TABLES[table]).parquet(f"{root}/{table}"), table, as_of)
        for table, (_, _, as_of) in _INTAKE.items()
    ]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("str_retention_rows", """
SELECT event_id, timestamp FROM page_views WHERE timestamp + INTERVAL 1 YEAR > TIMESTAMP '2025-01-20 00:00:00'""")
def str_retention_rows(v: ShopViews) -> DataFrame:
    kept = retention.apply_retention(v.page_views, "page_views", dt.datetime(2025, 1, 20), "timestamp")
    return kept.select("event_id", F.col("timestamp"))
