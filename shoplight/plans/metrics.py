"""Aggregates: traffic, sessions, funnel, searches, services, orders and catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.operators import catalogue, funnel, games, orders, reports, service, traffic
from shoplight.plans.check_views import rounded_mean_sql
from shoplight.plans.joins import stats
from shoplight.plans.registry import query
from shoplight.sources.shop_views import ShopViews

REALTIME = """
SELECT date_trunc('minute', timestamp) AS minute, count(*) AS page_views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT user_id) AS unique_users, avg(time_on_page_seconds) AS avg_time_on_page
FROM page_views WHERE timestamp >= {as_of} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 60"""
BEHAVIOR = """
SELECT CAST(session_start_time AS DATE) AS date, count(*) AS total_sessions, count(DISTINCT user_id) AS unique_users,
       avg(session_duration_seconds) AS avg_session_duration, avg(page_views) AS avg_pages_per_session,
       count(*) FILTER (WHERE page_views = 1) AS bounce_sessions,
       round(count(*) FILTER (WHERE page_views = 1) / count(*) * 100, 2) AS bounce_rate
FROM user_sessions WHERE session_start_time >= {as_of} - INTERVAL 7 DAY GROUP BY 1"""
FUNNEL = """
SELECT funnel_step, count(*) AS step_count, count(DISTINCT session_id) AS unique_sessions,
       CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM purchase_events WHERE purchase_timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY funnel_step"""
SEARCH = """
SELECT search_query, count(*) AS search_count, count(DISTINCT session_id) AS unique_searchers,
       avg(results_count) AS avg_results, count(*) FILTER (WHERE no_results) AS no_results_count,
       count(clicked_result_position) AS clicks,
       round(count(clicked_result_position) / count(*) * 100, 2) AS click_through_rate
FROM search_events WHERE timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY search_query
ORDER BY search_count DESC, search_query LIMIT 20"""
PERFORMANCE = """
SELECT service_name, metric_type, round(avg(metric_value), 6) AS avg_value, min(metric_value) AS min_value,
       max(metric_value) AS max_value, round(quantile_cont(metric_value, 0.95), 6) AS p95_value, count(*) AS sample_count
FROM performance_metrics WHERE timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY service_name, metric_type"""
POPULARITY = """
SELECT game_title, game_category, count(*) AS total_interactions, count(DISTINCT session_id) AS unique_sessions,
       count(*) FILTER (WHERE event_type = 'view') AS views,
       count(*) FILTER (WHERE event_type = 'add_to_cart') AS cart_additions,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       round(count(*) FILTER (WHERE event_type = 'purchase')
             / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) * 100, 2) AS conversion_rate
FROM game_interactions WHERE timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY game_title, game_category
ORDER BY total_interactions DESC, game_title, game_category LIMIT 20"""


def realtime(v: ShopViews, as_of: dt.datetime) -> DataFrame:
    return traffic.realtime_metrics(v.page_views, "24 HOUR", as_of)


@query("agg_realtime", REALTIME)
def agg_realtime(v: ShopViews) -> DataFrame:
    return realtime(v, v.newest_event())


@query("agg_game_popularity", POPULARITY)
def agg_game_popularity(v: ShopViews) -> DataFrame:
    return games.game_popularity(v.game_interactions, "7 DAY", v.newest_event())


@query("agg_funnel", FUNNEL)
def agg_funnel(v: ShopViews) -> DataFrame:
    return funnel.conversion_funnel(v.purchase_events, "7 DAY", v.newest_event())


@query("agg_funnel_by_count", """
SELECT funnel_step, count(*) AS step_count, count(DISTINCT session_id) AS unique_sessions
FROM purchase_events WHERE purchase_timestamp >= {as_of} - INTERVAL 7 DAY GROUP BY funnel_step""")
def agg_funnel_by_count(v: ShopViews) -> DataFrame:
    return funnel.funnel_by_count(v.purchase_events, "7 DAY", v.newest_event())


@query("agg_user_behavior", BEHAVIOR)
def agg_user_behavior(v: ShopViews) -> DataFrame:
    return traffic.user_behavior(v.user_sessions, "7 DAY", v.newest_event())


@query("agg_search", SEARCH)
def agg_search(v: ShopViews) -> DataFrame:
    return traffic.search_analytics(v.search_events, "7 DAY", v.newest_event())


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("avg_value", "p95_value")})


@query("agg_performance", PERFORMANCE)
def agg_performance(v: ShopViews) -> DataFrame:
    return _rounded(service.performance_metrics(v.performance_metrics, "7 DAY", v.newest_event(), exact=True))


@query("agg_performance_sketch", """
SELECT service_name, metric_type, count(*) AS sample_count, min(metric_value) AS min_value, max(metric_value) AS max_value,
       true AS p95_close
FROM performance_metrics GROUP BY service_name, metric_type""")
def agg_performance_sketch(v: ShopViews) -> DataFrame:
    """The one-pass estimate, held against the ranks of the whole tables."""
    estimate = service.performance_metrics(v.performance_metrics, "10 YEAR", v.newest_event())
    rank_low = F.count_if(F.col("metric_value") < F.col("p95_value"))
    rank_high = F.count_if(F.col("metric_value") <= F.col("p95_value"))
    close = (rank_low <= F.ceil(F.count("*") * 0.951)) & (rank_high >= F.floor(F.count("*") * 0.949))
    return v.performance_metrics.join(estimate, service.KEYS).groupBy(
        *service.KEYS, "sample_count", "min_value", "max_value"
    ).agg(close.alias("p95_close"))


@query("agg_performance_map", PERFORMANCE)
def agg_performance_map(v: ShopViews) -> DataFrame:
    maps = service.performance_by_service(
        service.performance_metrics(v.performance_metrics, "7 DAY", v.newest_event(), exact=True)
    )
    rows = maps.select("service_name", F.explode("metrics").alias("metric_type", "m"))
    return _rounded(rows.select(
        "service_name", "metric_type", F.col("m.avg").alias("avg_value"), F.col("m.min").alias("min_value"),
        F.col("m.max").alias("max_value"), F.col("m.p95").alias("p95_value"), F.col("m.samples").alias("sample_count"),
    ))


@query("agg_hourly_traffic", """
SELECT date_trunc('hour', timestamp) AS hour, count(*) AS page_views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT user_id) AS unique_users
FROM page_views WHERE timestamp >= {as_of} - INTERVAL 24 HOUR GROUP BY 1""")
def agg_hourly_traffic(v: ShopViews) -> DataFrame:
    return traffic.hourly_traffic(v.page_views, "24 HOUR", v.newest_event())


EXPORT_PAGES = """
SELECT CAST(timestamp AS DATE) AS date, page_category, count(*) AS page_views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT user_id) AS unique_users, avg(time_on_page_seconds) AS avg_time_on_page,
       avg(scroll_depth_percentage) AS avg_scroll_depth
FROM page_views WHERE timestamp >= {as_of} - INTERVAL 30 DAY GROUP BY 1, 2"""


@query("agg_export_pages", EXPORT_PAGES)
def agg_export_pages(v: ShopViews) -> DataFrame:
    return traffic.export_page_views(v.page_views, "30 DAY", v.newest_event())


@query("agg_export_interactions", """
SELECT CAST(timestamp AS DATE) AS date, game_id, game_title, game_category, event_type AS interaction_type,
       count(*) AS interactions, count(DISTINCT session_id) AS unique_sessions,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(event_data->>'$.k' AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS revenue
FROM game_interactions WHERE timestamp >= {as_of} - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4, 5""")
def agg_export_interactions(v: ShopViews) -> DataFrame:
    return games.export_interactions(v.game_interactions, "30 DAY", v.newest_event(), value_path="$.k")


@query("agg_export_sessions", """
SELECT CAST(session_start_time AS DATE) AS date, device_type, browser, country, count(*) AS sessions,
       count(DISTINCT user_id) AS unique_users, avg(session_duration_seconds) AS avg_session_duration,
       avg(page_views) AS avg_pages_per_session
FROM user_sessions WHERE session_start_time >= {as_of} - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4""")
def agg_export_sessions(v: ShopViews) -> DataFrame:
    return traffic.export_sessions(v.user_sessions, "30 DAY", v.newest_event())


@query("agg_views_by_category", """
SELECT page_category, count(*) AS page_views FROM page_views WHERE timestamp >= {as_of} - INTERVAL 30 DAY
GROUP BY page_category""")
def agg_views_by_category(v: ShopViews) -> DataFrame:
    return traffic.views_by_category(traffic.export_page_views(v.page_views, "30 DAY", v.newest_event()))


@query("agg_monthly_sales", """
SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS orders_count,
       CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS average_order_value
FROM shop_orders GROUP BY 1""")
def agg_monthly_sales(v: ShopViews) -> DataFrame:
    return orders.monthly_sales(v.orders)


@query("agg_daily_orders", """
SELECT CAST(created_at AS DATE) AS order_date, count(*) AS orders_count, CAST(sum(total_amount) AS DOUBLE) AS daily_revenue
FROM shop_orders
WHERE created_at >= CAST((SELECT max(o_orderdate) FROM orders) AS DATE) - INTERVAL 7 DAY GROUP BY 1""")
def agg_daily_orders(v: ShopViews) -> DataFrame:
    return orders.daily_orders(v.orders, 7)


@query("agg_order_summary", f"""
SELECT count(*) AS total_orders, count(*) FILTER (WHERE order_status = 'pending') AS pending_orders,
       count(*) FILTER (WHERE order_status = 'completed') AS completed_orders,
       count(*) FILTER (WHERE order_status = 'shipped') AS shipped_orders,
       count(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders,
       {rounded_mean_sql('total_amount')} AS average_order_value,
       CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(DISTINCT customer_id) AS unique_customers
FROM shop_orders""")
def agg_order_summary(v: ShopViews) -> DataFrame:
    return orders.order_summary(v.orders)


@query("agg_status_breakdown", "SELECT order_status, count(*) AS order_count FROM shop_orders GROUP BY order_status")
def agg_status_breakdown(v: ShopViews) -> DataFrame:
    return orders.status_breakdown(v.orders)


@query("agg_revenue_summary", f"""
SELECT count(*) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       {rounded_mean_sql('total_amount')} AS average_order_value
FROM shop_orders""")
def agg_revenue_summary(v: ShopViews) -> DataFrame:
    return orders.revenue_summary(v.orders)


@query("agg_customer_stats", f"""
SELECT customer_id, count(*) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_spent,
       {rounded_mean_sql('total_amount')} AS average_order_value
FROM shop_orders GROUP BY customer_id""")
def agg_customer_stats(v: ShopViews) -> DataFrame:
    return orders.customer_stats(v.orders)


@query("agg_catalogue_summary", f"""
SELECT count(*) AS total_games, count(*) FILTER (WHERE is_featured) AS featured_games,
       count(*) FILTER (WHERE is_trending) AS trending_games, {rounded_mean_sql('price')} AS average_price,
       count(DISTINCT category) AS total_categories, {rounded_mean_sql('rating')} AS average_rating
FROM games""")
def agg_catalogue_summary(v: ShopViews) -> DataFrame:
    return catalogue.catalogue_summary(v.games)


@query("agg_catalogue_category", f"""
SELECT category, count(*) AS game_count, {rounded_mean_sql('price')} AS avg_price,
       {rounded_mean_sql('rating')} AS avg_rating
FROM games GROUP BY category""")
def agg_catalogue_category(v: ShopViews) -> DataFrame:
    return catalogue.catalogue_by_category(v.games)


@query("agg_game_ratings", """
SELECT g.game_id, g.name, round(avg(r.rating), 2) AS average_rating, count(r.review_id) AS review_count
FROM games g LEFT JOIN game_reviews r ON g.game_id = r.game_id GROUP BY g.game_id, g.name""")
def agg_game_ratings(v: ShopViews) -> DataFrame:
    return catalogue.game_ratings(v.games.select("game_id", "name"), v.game_reviews)


@query("agg_game_ratings_verified", """
SELECT g.game_id, g.name, round(avg(r.rating), 2) AS average_rating, count(r.review_id) AS review_count
FROM games g LEFT JOIN (SELECT * FROM game_reviews WHERE is_verified_purchase) r ON g.game_id = r.game_id
GROUP BY g.game_id, g.name""")
def agg_game_ratings_verified(v: ShopViews) -> DataFrame:
    return catalogue.game_ratings(v.games.select("game_id", "name"), v.game_reviews, verified_only=True)


@query("agg_top_sellers", """
SELECT game_id, name, total_sold, CAST(total_revenue AS DOUBLE) AS total_revenue FROM game_stats
ORDER BY total_sold DESC NULLS LAST, game_id LIMIT 5""")
def agg_top_sellers(v: ShopViews) -> DataFrame:
    return catalogue.top_sellers(stats(v), 5).select("game_id", "name", "total_sold", "total_revenue")


@query("agg_top_customers", """
SELECT customer_id, first_name, total_orders, total_spent, last_order_date FROM customer_summary""")
def agg_top_customers(v: ShopViews) -> DataFrame:
    ranked = orders.top_customers(orders.customer_order_summary(v.customers, v.orders))
    return ranked.select("customer_id", "first_name", "total_orders", "total_spent", "last_order_date")


@query("agg_dashboard_summary", f"""
WITH minutes AS ({REALTIME}), days AS ({BEHAVIOR})
SELECT CAST(sum(page_views) AS BIGINT) AS total_page_views, CAST(sum(unique_sessions) AS BIGINT) AS total_sessions,
       CAST(sum(unique_users) AS BIGINT) AS total_users,
       round((SELECT avg(avg_session_duration) FROM days), 6) AS avg_session_duration,
       round((SELECT avg(bounce_rate) FROM days), 6) AS bounce_rate
FROM minutes""")
def agg_dashboard_summary(v: ShopViews) -> DataFrame:
    as_of = v.newest_event()
    summary = traffic.dashboard_summary(realtime(v, as_of), traffic.user_behavior(v.user_sessions, "7 DAY", as_of))
    return summary.withColumns({c: F.round(c, 6) for c in ("avg_session_duration", "bounce_rate")})


@query("agg_dashboard_exact", """
SELECT count(*) AS total_page_views, count(DISTINCT session_id) AS total_sessions, count(DISTINCT user_id) AS total_users,
       (SELECT avg(session_duration_seconds) FROM user_sessions
        WHERE session_start_time >= {as_of} - INTERVAL 7 DAY) AS avg_session_duration,
       (SELECT round(avg(CASE WHEN user_sessions.page_views = 1 THEN 1.0 ELSE 0.0 END) * 100, 2) FROM user_sessions
        WHERE session_start_time >= {as_of} - INTERVAL 7 DAY) AS bounce_rate
FROM page_views WHERE timestamp >= {as_of} - INTERVAL 24 HOUR""")
def agg_dashboard_exact(v: ShopViews) -> DataFrame:
    return traffic.dashboard_summary_exact(v.page_views, v.user_sessions, as_of=v.newest_event())


@query("agg_activity_probe", f"""
WITH minutes AS ({REALTIME})
SELECT arg_max(page_views, minute) AS last_hour_page_views, arg_max(unique_sessions, minute) AS unique_sessions,
       count(*) AS data_points
FROM minutes""")
def agg_activity_probe(v: ShopViews) -> DataFrame:
    return traffic.recent_activity_probe(realtime(v, v.newest_event()))


@query("agg_search_totals", f"""
WITH top AS ({SEARCH})
SELECT CAST(sum(search_count) AS BIGINT) AS total_searches, CAST(sum(unique_searchers) AS BIGINT) AS total_unique_searchers
FROM top""")
def agg_search_totals(v: ShopViews) -> DataFrame:
    return traffic.search_totals(traffic.search_analytics(v.search_events, "7 DAY", v.newest_event()))


@query("agg_funnel_revenue", """
SELECT CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM purchase_events
WHERE purchase_timestamp >= {as_of} - INTERVAL 7 DAY""")
def agg_funnel_revenue(v: ShopViews) -> DataFrame:
    return funnel.funnel_revenue(funnel.conversion_funnel(v.purchase_events, "7 DAY", v.newest_event()))


@query("agg_game_scoreboard", """
SELECT game_id, game_title, game_category, views, purchases, conversion_rate, CAST(revenue AS DOUBLE) AS revenue
FROM scoreboard""")
def agg_game_scoreboard(v: ShopViews) -> DataFrame:
    return games.game_scoreboard(v.game_interactions, v.purchase_events)


@query("agg_sales_category", """
SELECT category, CAST(sum(quantity) AS BIGINT) AS sales, CAST(sum(total_price) AS DOUBLE) AS revenue
FROM order_items i JOIN games g ON i.game_id = g.game_id GROUP BY category""")
def agg_sales_category(v: ShopViews) -> DataFrame:
    return orders.sales_by_category(v.order_items, v.games)


@query("agg_sales_headline", f"""
SELECT count(*) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       {rounded_mean_sql('total_amount')} AS average_order_value,
       (SELECT round(count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'view') * 100, 2)
        FROM game_interactions) AS conversion_rate
FROM shop_orders""")
def agg_sales_headline(v: ShopViews) -> DataFrame:
    return orders.sales_headline(v.orders, v.game_interactions)


@query("agg_user_counts", """
SELECT count(*) AS total_users, count(*) FILTER (WHERE newest >= {as_of} - INTERVAL 1 DAY) AS active_users,
       count(*) FILTER (WHERE oldest >= {as_of} - INTERVAL 1 DAY) AS new_users,
       count(*) FILTER (WHERE newest >= {as_of} - INTERVAL 1 DAY AND oldest < {as_of} - INTERVAL 1 DAY) AS returning_users
FROM (SELECT user_id, min(timestamp) AS oldest, max(timestamp) AS newest FROM some_anonymous
      WHERE user_id IS NOT NULL GROUP BY user_id)""")
def agg_user_counts(v: ShopViews) -> DataFrame:
    return traffic.user_counts(v.some_anonymous, "1 DAY", v.newest_event())


@query("agg_views_4h", """
SELECT CAST(hour(timestamp) // 4 * 4 AS INTEGER) AS hour_of_day, count(*) AS page_views FROM page_views GROUP BY 1""")
def agg_views_4h(v: ShopViews) -> DataFrame:
    return traffic.views_by_hours_of_day(v.page_views, 4)


@query("agg_active_2h", """
SELECT CAST(hour(timestamp) // 2 * 2 AS INTEGER) AS hour_of_day, count(DISTINCT user_id) AS active_users FROM page_views GROUP BY 1""")
def agg_active_2h(v: ShopViews) -> DataFrame:
    return traffic.active_users_by_hours_of_day(v.page_views, 2)


@query("agg_price_orders", """
SELECT order_id, order_status, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_amount AS DOUBLE) AS tax_amount,
       CAST(shipping_cost AS DOUBLE) AS shipping_cost, CAST(subtotal + tax_amount + shipping_cost AS DOUBLE) AS total_amount,
       DATE '2024-01-31' + 5 AS estimated_delivery
FROM priced_orders""")
def agg_price_orders(v: ShopViews) -> DataFrame:
    return orders.price_orders(v.order_items, dt.date(2024, 1, 31))


@query("agg_price_lines", """
SELECT id, CAST(coalesce(nullif(discount_price, 0), unit_price) * quantity AS DOUBLE) AS total_price FROM order_items""")
def agg_price_lines(v: ShopViews) -> DataFrame:
    return orders.price_lines(v.order_items).select("id", "total_price")


def _cart_lines(v: ShopViews) -> DataFrame:
    adds = v.game_interactions.filter(F.col("event_type") == "add_to_cart").select(
        F.col("session_id").alias("cart_id"), "game_id", F.lit(None).cast("int").alias("quantity")
    )
    return orders.merge_cart(adds.join(v.games.select("game_id", "price"), "game_id"))


CART = """
SELECT i.session_id AS cart_id, i.game_id, count(*) AS quantity, max(g.price) AS price
FROM game_interactions i JOIN games g ON i.game_id = g.game_id WHERE event_type = 'add_to_cart' GROUP BY 1, 2"""


@query("agg_merge_cart", f"SELECT cart_id, game_id, quantity, CAST(price AS DOUBLE) AS price FROM ({CART})")
def agg_merge_cart(v: ShopViews) -> DataFrame:
    return _cart_lines(v)


@query("agg_cart_totals", f"""
SELECT cart_id, CAST(sum(quantity) AS BIGINT) AS unit_count, count(*) AS unique_items,
       CAST(sum(price * quantity) AS DOUBLE) AS cart_value
FROM ({CART}) GROUP BY cart_id""")
def agg_cart_totals(v: ShopViews) -> DataFrame:
    return orders.cart_totals(_cart_lines(v))


@query("agg_library", """
SELECT o.customer_id AS user_id, i.game_id, min(o.created_at) AS purchased_at
FROM order_items i JOIN shop_orders o ON i.order_id = o.order_id GROUP BY 1, 2""")
def agg_library(v: ShopViews) -> DataFrame:
    return orders.game_library(v.order_items, v.orders)


@query("agg_report", f"""
SELECT section, subject, metric, value FROM (
  SELECT 'sales' AS section, 'all' AS subject, count(*) AS n, sum(total_amount) AS s,
         {rounded_mean_sql('total_amount')} AS mean FROM shop_orders
  WHERE created_at >= DATE '1996-01-01' AND created_at < DATE '2025-01-01'
) CROSS JOIN LATERAL (VALUES ('total_orders', CAST(n AS DOUBLE)), ('total_revenue', CAST(s AS DOUBLE)),
                             ('average_order_value', mean)) m(metric, value)
UNION ALL
SELECT 'games', CAST(game_id AS VARCHAR), metric, value FROM scoreboard
CROSS JOIN LATERAL (VALUES ('views', CAST(views AS DOUBLE)), ('purchases', CAST(purchases AS DOUBLE)),
                           ('conversion_rate', conversion_rate), ('revenue', CAST(revenue AS DOUBLE))) m(metric, value)
WHERE lower(game_category) = 'economy'
UNION ALL
SELECT 'users', 'all', metric, value FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE newest >= b) AS active, count(*) FILTER (WHERE oldest >= b) AS fresh,
         count(*) FILTER (WHERE newest >= b AND oldest < b) AS back
  FROM (SELECT user_id, min(timestamp) AS oldest, max(timestamp) AS newest,
               (SELECT max(timestamp) FROM page_views) - INTERVAL 7 DAY AS b FROM page_views GROUP BY user_id)
) CROSS JOIN LATERAL (VALUES ('total_users', CAST(total AS DOUBLE)), ('active_users', CAST(active AS DOUBLE)),
                             ('new_users', CAST(fresh AS DOUBLE)), ('returning_users', CAST(back AS DOUBLE))) m(metric, value)""")
def agg_report(v: ShopViews) -> DataFrame:
    spec = {
        "reportName": "Sales and games", "metrics": ["games", "sales", "users"],
        "dateRange": {"start": "1996-01-01", "end": "2024-12-31"}, "filters": {"category": "Economy"},
    }
    tables = {
        "orders": v.orders, "game_interactions": v.game_interactions, "purchase_events": v.purchase_events,
        "page_views": v.page_views,
    }
    return reports.build_report(spec, tables)


@query("agg_adhoc_sql", """
SELECT category, count(*) AS n, CAST(max(price) AS DOUBLE) AS top_price FROM games WHERE price >= 905 GROUP BY category""")
def agg_adhoc_sql(v: ShopViews) -> DataFrame:
    text = "SELECT category, count(*) AS n, max(price) AS top_price FROM report_games WHERE price >= :least GROUP BY category"
    return reports.run_report(v.spark, text, {"report_games": v.games}, {"least": 905})
