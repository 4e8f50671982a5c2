"""Joins of orders, customers, addresses, games, reviews and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.operators import catalogue, games, orders, paging, quality
from shoplight.operators.sequences import status_history
from shoplight.plans.registry import query
from shoplight.session import stored
from shoplight.sources.shop_views import ShopViews


def stats(v: ShopViews) -> DataFrame:
    return catalogue.game_stats(v.games, v.game_reviews, v.order_items)


@query("jn_orders_customer", """
SELECT o.order_id, o.order_status, CAST(o.total_amount AS DOUBLE) AS total_amount, c.first_name, c.last_name, c.email, c.phone,
       (SELECT count(*) FROM shop_orders WHERE order_status = 'pending') AS total_items
FROM shop_orders o LEFT JOIN customers c ON o.customer_id = c.customer_id WHERE o.order_status = 'pending'
ORDER BY o.total_amount DESC, o.order_id LIMIT 10 OFFSET 10""")
def jn_orders_customer(v: ShopViews) -> DataFrame:
    pending = orders.filter_orders(v.orders, status="pending")
    order = paging.sort_keys("total_amount", "DESC", ("created_at", "total_amount", "order_status"), "created_at", "order_id")
    page = paging.paginate(pending, order, page=2, limit=10)
    return orders.orders_with_customer(page, v.customers).select(
        "order_id", "order_status", "total_amount", "first_name", "last_name", "email", "phone", "total_items"
    )


@query("jn_order_full", """
SELECT o.order_id, o.order_status, CAST(o.total_amount AS DOUBLE) AS total_amount, c.first_name, c.email,
       s.address_line_1 AS ship_address_line_1, s.city AS ship_city, s.country AS ship_country,
       b.address_line_1 AS bill_address_line_1, b.city AS bill_city, b.country AS bill_country
FROM shop_orders o LEFT JOIN customers c ON o.customer_id = c.customer_id
LEFT JOIN customer_addresses s ON o.shipping_address_id = s.address_id
LEFT JOIN customer_addresses b ON o.billing_address_id = b.address_id""")
def jn_order_full(v: ShopViews) -> DataFrame:
    return orders.order_full_detail(v.orders, v.customers, v.customer_addresses).select(
        "order_id", "order_status", "total_amount", "first_name", "email", "ship_address_line_1", "ship_city",
        "ship_country", "bill_address_line_1", "bill_city", "bill_country",
    )


@query("jn_order_details", """
SELECT o.order_id, o.order_status, CAST(o.total_amount AS DOUBLE) AS total_amount, o.payment_method, o.payment_status,
       o.created_at AS order_date, c.customer_id, c.first_name, c.last_name, c.email,
       s.address_line_1 AS shipping_address, s.city AS shipping_city, s.country AS shipping_country
FROM shop_orders o JOIN customers c ON o.customer_id = c.customer_id
LEFT JOIN customer_addresses s ON o.shipping_address_id = s.address_id""")
def jn_order_details(v: ShopViews) -> DataFrame:
    return orders.order_details(v.orders, v.customers, v.customer_addresses)


_STATS = """game_id, name, category, CAST(price AS DOUBLE) AS price, CAST(discount_price AS DOUBLE) AS discount_price,
       average_rating, review_count, total_sold, CAST(total_revenue AS DOUBLE) AS total_revenue"""


@query("jn_game_stats", f"SELECT {_STATS} FROM game_stats")
def jn_game_stats(v: ShopViews) -> DataFrame:
    return stats(v)


@query("jn_game_stats_dedup", f"""
SELECT {_STATS} FROM (
  SELECT g.game_id, g.name, g.category, g.price, g.discount_price, r.average_rating, coalesce(r.n, 0) AS review_count,
         s.units AS total_sold, s.revenue AS total_revenue
  FROM games g
  LEFT JOIN (SELECT game_id, round(avg(rating), 2) AS average_rating, count(*) AS n FROM game_reviews GROUP BY game_id) r
         ON g.game_id = r.game_id
  LEFT JOIN (SELECT game_id, CAST(sum(quantity) AS BIGINT) AS units, sum(total_price) AS revenue FROM order_items
             GROUP BY game_id) s ON g.game_id = s.game_id)""")
def jn_game_stats_dedup(v: ShopViews) -> DataFrame:
    return catalogue.game_stats_dedup(v.games, v.game_reviews, v.order_items)


@query("jn_customer_summary", "SELECT * FROM customer_summary")
def jn_customer_summary(v: ShopViews) -> DataFrame:
    return orders.customer_order_summary(v.customers, v.orders)


@query("jn_trending", """
SELECT g.game_id, g.name, g.category, CAST(g.rating AS DOUBLE) AS rating, coalesce(s.total_sold, 0) AS total_sold
FROM games g LEFT JOIN game_stats s ON g.game_id = s.game_id WHERE g.is_trending
ORDER BY s.total_sold DESC NULLS LAST, g.rating DESC, g.game_id LIMIT 6""")
def jn_trending(v: ShopViews) -> DataFrame:
    return catalogue.trending_games(v.games, stats(v), 6).select("game_id", "name", "category", "rating", "total_sold")


@query("jn_reviews_author", """
SELECT r.review_id, r.game_id, r.user_id, r.rating, c.first_name, c.last_name
FROM game_reviews r LEFT JOIN customers c ON r.user_id = c.customer_id""")
def jn_reviews_author(v: ShopViews) -> DataFrame:
    return catalogue.reviews_with_author(v.game_reviews, v.customers).select(
        "review_id", "game_id", "user_id", "rating", "first_name", "last_name"
    )


@query("jn_game_revenue", """
SELECT i.game_title, i.game_category, count(*) AS interactions, count(DISTINCT i.session_id) AS unique_sessions,
       count(*) FILTER (WHERE i.event_type = 'purchase') AS purchases,
       CAST(coalesce(sum(p.total_amount), 0) AS DOUBLE) AS revenue
FROM game_interactions i LEFT JOIN purchase_events p ON i.game_id = p.game_id
WHERE i.timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY i.game_title, i.game_category""")
def jn_game_revenue(v: ShopViews) -> DataFrame:
    return games.game_revenue_join(v.game_interactions, v.purchase_events, "7 DAY", v.newest_event())


@query("jn_game_revenue_dedup", """
SELECT i.*, CAST(coalesce(p.revenue, 0) AS DOUBLE) AS revenue
FROM (SELECT game_id, game_title, game_category, count(*) AS interactions, count(DISTINCT session_id) AS unique_sessions,
             count(*) FILTER (WHERE event_type = 'purchase') AS purchases
      FROM game_interactions WHERE timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY game_id, game_title, game_category) i
LEFT JOIN (SELECT game_id, sum(total_amount) AS revenue FROM purchase_events GROUP BY game_id) p ON i.game_id = p.game_id""")
def jn_game_revenue_dedup(v: ShopViews) -> DataFrame:
    return games.game_revenue_dedup(v.game_interactions, v.purchase_events, "7 DAY", v.newest_event())


@query("jn_category_perf", """
SELECT g.category, count(*) AS games_count, CAST(sum(g.price) AS DOUBLE) / count(g.price) AS average_price,
       CAST(sum(coalesce(s.total_sold, 0)) AS BIGINT) AS total_sold,
       CAST(sum(coalesce(s.total_revenue, 0)) AS DOUBLE) AS total_revenue
FROM games g LEFT JOIN game_stats s ON g.game_id = s.game_id GROUP BY g.category""")
def jn_category_perf(v: ShopViews) -> DataFrame:
    return catalogue.category_performance(v.games, stats(v))


def _order_documents_sql(page_rows: int) -> str:
    return f"""
WITH lines AS (SELECT order_id, id, (row_number() OVER (PARTITION BY order_id ORDER BY created_at, id, game_id, quantity) - 1) // {page_rows} AS page,
                      created_at, game_id, quantity, CAST(id AS VARCHAR) || ':' || quantity AS entry FROM order_items),
     changed AS (SELECT order_id, before, order_status, updated_at FROM (
                     SELECT *, lag(order_status) OVER (PARTITION BY order_id ORDER BY updated_at, seq) AS before FROM status_snapshots)
                 WHERE before IS NOT NULL AND order_status <> before),
     changes AS (SELECT *, (row_number() OVER (PARTITION BY order_id ORDER BY updated_at, before, order_status) - 1) // {page_rows} AS page
                 FROM changed),
     i AS (SELECT order_id, page, string_agg(entry, ',' ORDER BY created_at, id, game_id, quantity) AS items FROM lines GROUP BY ALL),
     h AS (SELECT order_id, page, string_agg(before || '>' || order_status || '@' || CAST(epoch_us(updated_at) AS VARCHAR), ','
                                             ORDER BY updated_at, before, order_status) AS changes FROM changes GROUP BY ALL),
     parts AS (SELECT order_id, page, items, changes FROM i FULL JOIN h USING (order_id, page))
SELECT o.order_id, CAST(coalesce(page, 0) AS BIGINT) AS page, coalesce(items, '') AS items, coalesce(changes, '') AS changes
FROM shop_orders o LEFT JOIN parts p ON o.order_id = p.order_id"""


def _order_documents(v: ShopViews, page_rows: int) -> DataFrame:
    """Every entry of both arrays, as text."""
    documents = orders.order_documents(v.orders, v.order_items, status_history(v.status_snapshots), page_rows)
    line = lambda e: F.concat_ws(":", e["id"], e["quantity"])
    change = lambda e: F.concat(
        e["previous_status"], F.lit(">"), e["new_status"], F.lit("@"), F.unix_micros(e["created_at"].cast("timestamp")).cast("string"))
    joined = lambda name, entry: F.coalesce(F.array_join(F.transform(name, entry), ","), F.lit(""))
    return documents.select("order_id", "page", joined("items", line).alias("items"), joined("status_history", change).alias("changes"))


@query("jn_order_documents", _order_documents_sql(1000))
def jn_order_documents(v: ShopViews) -> DataFrame:
    return _order_documents(v, 1000)


@query("jn_order_documents_paged", _order_documents_sql(2))
def jn_order_documents_paged(v: ShopViews) -> DataFrame:
    return _order_documents(v, 2)


@query("jn_game_documents", """
SELECT g.game_id, g.name, r.average_rating, coalesce(r.n, 0) AS review_count, CAST(coalesce(t.kept, 0) AS INTEGER) AS recent_reviews,
       t.newest_review, t.newest_author
FROM games g
LEFT JOIN (SELECT game_id, round(avg(rating), 2) AS average_rating, count(*) AS n FROM game_reviews GROUP BY game_id) r
       ON g.game_id = r.game_id
LEFT JOIN (SELECT game_id, count(*) AS kept, min(CASE WHEN pos = 1 THEN review_id END) AS newest_review,
                  min(CASE WHEN pos = 1 THEN first_name END) AS newest_author
           FROM (SELECT review_id, game_id, first_name,
                        row_number() OVER (PARTITION BY game_id ORDER BY created_at DESC, review_id) AS pos
                 FROM game_reviews LEFT JOIN customers ON user_id = customer_id)
           WHERE pos <= 5 GROUP BY game_id) t ON g.game_id = t.game_id""")
def jn_game_documents(v: ShopViews) -> DataFrame:
    pages = catalogue.game_documents(v.games, v.game_reviews, v.customers)
    newest = F.get("reviews", F.lit(0))
    return pages.select(
        "game_id", "name", "average_rating", "review_count",
        F.coalesce(F.array_size("reviews"), F.lit(0)).alias("recent_reviews"),
        newest["review_id"].alias("newest_review"), newest["first_name"].alias("newest_author"),
    )


@query("jn_delete_cascade", """
SELECT 'cascade' AS mode, r.game_id, count(*) AS review_count FROM game_reviews r
WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.stock_quantity = 0 AND g.game_id = r.game_id) GROUP BY r.game_id
UNION ALL
SELECT 'set_null', CASE WHEN g.game_id IS NULL THEN r.game_id END, count(*) FROM game_reviews r
LEFT JOIN (SELECT game_id FROM games WHERE stock_quantity = 0) g ON g.game_id = r.game_id GROUP BY 2""")
def jn_delete_cascade(v: ShopViews) -> DataFrame:
    gone = v.games.filter(F.col("stock_quantity") == 0)
    reviews = v.game_reviews.select("review_id", "game_id")
    per_game = lambda mode: quality.propagate_delete(reviews, gone, "game_id", mode).groupBy("game_id").agg(
        F.count("*").alias("review_count")
    ).select(F.lit(mode).alias("mode"), "game_id", "review_count")
    return per_game("cascade").unionAll(per_game("set_null"))
