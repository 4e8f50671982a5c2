"""Filters, text search, sorted and paged lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.functions.scalars import funnel_position
from shoplight.functions.times import trailing
from shoplight.operators import catalogue, orders, paging
from shoplight.operators.games import game_scoreboard, leaderboard, popularity_rank
from shoplight.operators.orders import daily_orders
from shoplight.plans.registry import query
from shoplight.session import stored, work_dir
from shoplight.sources.shop_views import ShopViews


@query("flt_time_range", """
SELECT event_id, session_id, kind, timestamp FROM ev WHERE timestamp >= {as_of} - INTERVAL 7 DAY""")
def flt_time_range(v: ShopViews) -> DataFrame:
    return trailing(v.ev.select("event_id", "session_id", "kind", "timestamp"), "timestamp", "7 DAY", v.newest_event())


@query("flt_time_range_newest", """
SELECT event_id, timestamp FROM ev WHERE timestamp >= (SELECT max(timestamp) FROM ev) - INTERVAL 2 WEEK""")
def flt_time_range_newest(v: ShopViews) -> DataFrame:
    return trailing(v.ev.select("event_id", "timestamp"), "timestamp", "2 WEEK")


@query("flt_games", """
SELECT game_id, name, category, CAST(price AS DOUBLE) AS price,
       (SELECT count(*) FROM games WHERE category ILIKE '%an%' AND price >= 910 AND price <= 2000 AND is_featured) AS total_items
FROM games WHERE category ILIKE '%an%' AND price >= 910 AND price <= 2000 AND is_featured""")
def flt_games(v: ShopViews) -> DataFrame:
    found = catalogue.filter_games(v.games, category="an", min_price="910", max_price="2000", featured=True)
    return found.select("game_id", "name", "category", "price", found.agg(F.count("*")).scalar().alias("total_items"))


@query("flt_orders", """
SELECT order_id, customer_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount
FROM shop_orders WHERE order_status = 'shipped' AND customer_id = (SELECT min(customer_id) FROM shop_orders)
UNION ALL
SELECT order_id, customer_id, order_status, CAST(total_amount AS DOUBLE)
FROM shop_orders WHERE order_status = 'pending'""")
def flt_orders(v: ShopViews) -> DataFrame:
    first = v.orders.agg(F.min("customer_id")).scalar()
    columns = ["order_id", "customer_id", "order_status", "total_amount"]
    one = orders.filter_orders(v.orders, status="shipped", customer_id=first).select(*columns)
    return one.unionAll(orders.filter_orders(v.orders, status="pending").select(*columns))


@query("flt_category_ci", """
SELECT game_id, name, category FROM games WHERE lower(category) = 'standard' OR lower(publisher) = 'standard'
UNION ALL
SELECT game_id, 'any', category FROM games""")
def flt_category_ci(v: ShopViews) -> DataFrame:
    some = catalogue.eq_ci(v.games, ["category", "publisher"], ".Standard").select("game_id", "name", "category")
    every = catalogue.eq_ci(v.games, ["category"], "all").select("game_id", F.lit("any").alias("name"), "category")
    return some.unionAll(every)


@query("flt_in_stock", """
SELECT game_id, stock_quantity, stock_quantity > 0 AS in_stock FROM games""")
def flt_in_stock(v: ShopViews) -> DataFrame:
    columns = lambda df, flag: df.select("game_id", "stock_quantity", F.lit(flag).alias("in_stock"))
    return columns(catalogue.in_stock(v.games, True), True).unionAll(columns(catalogue.in_stock(v.games, False), False))


@query("flt_category_page", """
SELECT game_id, name, category, CAST(rating AS DOUBLE) AS rating, 2 AS current_page,
       CAST(ceil((SELECT count(*) FROM games WHERE category ILIKE '%econ%') / 10.0) AS BIGINT) AS total_pages,
       (SELECT count(*) FROM games WHERE category ILIKE '%econ%') AS total_items
FROM games WHERE category ILIKE '%econ%' ORDER BY rating DESC, name, game_id LIMIT 10 OFFSET 10""")
def flt_category_page(v: ShopViews) -> DataFrame:
    found = catalogue.games_in_category(v.games, "econ").select("game_id", "name", "category", "rating")
    page = paging.paginate(found, catalogue.category_order(), page=2, limit=10)
    return page.drop("items_per_page", "has_next_page", "has_previous_page")


@query("flt_membership", """
SELECT game_id, name, category FROM games WHERE stock_quantity > 0 AND category IN ('ECONOMY', 'PROMO')
ORDER BY game_id LIMIT 4""")
def flt_membership(v: ShopViews) -> DataFrame:
    return catalogue.trending_by_category(v.games, ["ECONOMY", "PROMO"], 4).select("game_id", "name", "category")


@query("flt_status", """
SELECT order_id, order_status, (SELECT count(*) FROM shop_orders WHERE order_status = 'delivered') AS status_count
FROM shop_orders WHERE order_status = 'delivered'""")
def flt_status(v: ShopViews) -> DataFrame:
    return orders.orders_by_status(v.orders.select("order_id", "order_status"), "Delivered")


@query("flt_cancellable", """
SELECT i.id AS order_id, o.order_status AS previous_status,
       CASE WHEN o.order_status = 'pending' THEN 'cancelled' ELSE o.order_status END AS order_status,
       CASE WHEN o.order_status IS NULL THEN 'not_found' WHEN o.order_status = 'pending' THEN 'cancelled'
            ELSE 'rejected' END AS outcome
FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem UNION SELECT -1 - p_partkey FROM part) i
LEFT JOIN shop_orders o ON i.id = o.order_id""")
def flt_cancellable(v: ShopViews) -> DataFrame:
    unknown = v.base("part").select((-1 - F.col("p_partkey")).alias("order_id"))
    return orders.cancel_orders(v.orders, v.order_items.select("order_id").unionAll(unknown))


@query("txt_full_text", """
SELECT game_id, name, category, CAST(rating AS DOUBLE) AS rating FROM games
WHERE (list_contains(string_split_regex(lower(name || ' ' || description || ' ' || array_to_string(tags, ' ')), '[^a-z0-9]+'), 'widget')
       AND list_contains(string_split_regex(lower(name || ' ' || description || ' ' || array_to_string(tags, ' ')), '[^a-z0-9]+'), 'red'))
   OR name ILIKE '%widget red%' OR description ILIKE '%widget red%' OR category ILIKE '%widget red%'
ORDER BY CASE WHEN name ILIKE '%widget red%' THEN 1 ELSE 2 END, rating DESC, game_id LIMIT 10""")
def txt_full_text(v: ShopViews) -> DataFrame:
    return catalogue.search_games(v.games, "widget red", 10).select("game_id", "name", "category", "rating")


_TEXT = "lower(name || ' ' || description || ' ' || array_to_string(tags, ' '))"


@query("txt_stop_words", f"""
SELECT game_id, name, category, CAST(rating AS DOUBLE) AS rating FROM games
WHERE list_contains(string_split_regex({_TEXT}, '[^\\p{{L}}\\p{{N}}]+'), 'red')
  AND list_contains(string_split_regex({_TEXT}, '[^\\p{{L}}\\p{{N}}]+'), 'title')
ORDER BY rating DESC, game_id LIMIT 10""")
def txt_stop_words(v: ShopViews) -> DataFrame:
    """Words that carry no meaning are not asked for."""
    return catalogue.search_games(v.games, "the title of RED", 10).select("game_id", "name", "category", "rating")


# Words of these tables and of the query below by their stems (known from the published algorithm's steps).
_STEMS = {"gear": ["gear", "gears", "geared", "gearing"], "titl": ["title", "titles", "titled", "titling"], "larg": ["large"]}
_ALL_STEMS = " AND ".join(
    f"list_has_any(string_split_regex({_TEXT}, '[^\\p{{L}}\\p{{N}}]+'), {words})" for words in _STEMS.values())


@query("txt_stems", f"""
SELECT game_id, name, category, CAST(rating AS DOUBLE) AS rating FROM games WHERE {_ALL_STEMS}
ORDER BY rating DESC, game_id LIMIT 10""")
def txt_stems(v: ShopViews) -> DataFrame:
    """Inflected words find their other forms."""
    return catalogue.search_games(v.games, "Gears titled large", 10).select("game_id", "name", "category", "rating")


@query("txt_substring", """
SELECT game_id, name, category, CAST(price AS DOUBLE) AS price FROM games
WHERE (contains(lower(name), 'ing') OR contains(lower(description), 'ing')
       OR len(list_filter(tags, lambda t: contains(lower(t), 'ing'))) > 0)
  AND lower(category) = 'economy' AND price >= 905 AND price <= 3000""")
def txt_substring(v: ShopViews) -> DataFrame:
    found = catalogue.search_substring(v.games, "ING", category="Economy", min_price="905", max_price="3000")
    return found.select("game_id", "name", "category", "price")


@query("ord_safe_sort", """
SELECT game_id, name, CAST(price AS DOUBLE) AS price FROM games ORDER BY price DESC, game_id""")
def ord_safe_sort(v: ShopViews) -> DataFrame:
    allowed = ("name", "price", "rating", "release_date", "created_at")
    return paging.safe_sort(v.games, "price", "desc", allowed, "name", "game_id").select("game_id", "name", "price")


@query("ord_paginate", """
SELECT order_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount, created_at, 3 AS current_page,
       CAST(ceil((SELECT count(*) FROM shop_orders) / 10.0) AS BIGINT) AS total_pages,
       (SELECT count(*) FROM shop_orders) AS total_items, 10 AS items_per_page,
       3 < ceil((SELECT count(*) FROM shop_orders) / 10.0) AS has_next_page, true AS has_previous_page
FROM shop_orders ORDER BY created_at DESC, order_id LIMIT 10 OFFSET 20""")
def ord_paginate(v: ShopViews) -> DataFrame:
    order = paging.sort_keys("no such column", "DESC", ("created_at", "total_amount", "order_status"), "created_at", "order_id")
    return paging.paginate(v.orders.select("order_id", "order_status", "total_amount", "created_at"), order, page=3, limit=10)


_FAR = "(SELECT ceil(count(*) / 10.0) FROM shop_orders)"


@query("ord_far_page", f"""
SELECT order_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount, created_at, CAST({_FAR} AS INTEGER) AS current_page,
       CAST({_FAR} AS BIGINT) AS total_pages, (SELECT count(*) FROM shop_orders) AS total_items, 10 AS items_per_page,
       false AS has_next_page, {_FAR} > 1 AS has_previous_page
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, order_id) AS no FROM shop_orders) WHERE no > ({_FAR} - 1) * 10""")
def ord_far_page(v: ShopViews) -> DataFrame:
    """The last page, from the range that holds it."""
    order = paging.sort_keys("created_at", "DESC", ("created_at",), "created_at", "order_id")
    root = work_dir(v.spark, "pages")
    rows = v.orders.select("order_id", "order_status", "total_amount", "created_at")
    paging.write_pages(rows, order, root)
    first = paging.stored_page(v.spark, root, order, 1, 10).first()
    return paging.stored_page(v.spark, root, order, first["total_pages"] if first else 1, 10)


@query("ord_offset_page", """
SELECT game_id, name, (SELECT count(*) FROM games) AS total, 35 < (SELECT count(*) FROM games) AS has_next, true AS has_prev
FROM games ORDER BY name, game_id LIMIT 10 OFFSET 25""")
def ord_offset_page(v: ShopViews) -> DataFrame:
    return paging.paginate_offset(v.games.select("game_id", "name"), [F.asc("name"), F.asc("game_id")], offset=25, limit=10)


@query("ord_keyset_page", """
SELECT order_id, created_at FROM shop_orders
WHERE created_at < TIMESTAMP '1998-01-01 00:00:00' OR (created_at = TIMESTAMP '1998-01-01 00:00:00' AND order_id > 0)
ORDER BY created_at DESC, order_id LIMIT 10""")
def ord_keyset_page(v: ShopViews) -> DataFrame:
    rows = v.orders.select("order_id", "created_at")
    return paging.page_after(rows, "created_at", "order_id", (dt.datetime(1998, 1, 1), 0), limit=10)


@query("ord_featured", """
SELECT game_id, name, CAST(rating AS DOUBLE) AS rating, created_at FROM games WHERE is_featured
ORDER BY rating DESC, created_at DESC, game_id LIMIT 4""")
def ord_featured(v: ShopViews) -> DataFrame:
    return catalogue.featured(v.games, 4).select("game_id", "name", "rating", "created_at")


@query("ord_featured_stock", """
SELECT game_id, name, stock_quantity FROM games WHERE stock_quantity > 0 ORDER BY stock_quantity DESC, game_id LIMIT 4""")
def ord_featured_stock(v: ShopViews) -> DataFrame:
    return catalogue.featured_by_stock(v.games, 4).select("game_id", "name", "stock_quantity")


@query("ord_leaderboard", """
SELECT * FROM (SELECT 'revenue' AS board, game_id, CAST(revenue AS DOUBLE) AS revenue, views, popularity_rank
               FROM scoreboard ORDER BY scoreboard.revenue DESC, game_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'popularity', game_id, CAST(revenue AS DOUBLE), views, popularity_rank
               FROM scoreboard WHERE lower(game_category) = 'economy' ORDER BY popularity_rank, game_id LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'conversion', game_id, CAST(revenue AS DOUBLE), views, popularity_rank
               FROM scoreboard ORDER BY conversion_rate DESC NULLS LAST, game_id LIMIT 10)""")
def ord_leaderboard(v: ShopViews) -> DataFrame:
    scores = stored(game_scoreboard(v.game_interactions, v.purchase_events), "scoreboard")
    board = popularity_rank(scores)
    named = lambda name, df: df.select(F.lit(name).alias("board"), "game_id", "revenue", "views", "popularity_rank")
    return (
        named("revenue", leaderboard(board, "revenue"))
        .unionAll(named("popularity", leaderboard(board, "popularity", "Economy", 5)))
        .unionAll(named("conversion", leaderboard(board, "conversion")))
    )


@query("ord_funnel_labels", """
SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'add_to_cart' THEN 2 WHEN 'checkout' THEN 3
                                   WHEN 'purchase' THEN 4 ELSE 5 END AS step_order, count(*) AS events
FROM game_interactions GROUP BY 1, 2""")
def ord_funnel_labels(v: ShopViews) -> DataFrame:
    step = funnel_position(F.col("event_type")).alias("step_order")
    return v.game_interactions.groupBy("event_type", step).agg(F.count("*").alias("events")).orderBy("step_order")


@query("ord_recent_days", """
SELECT CAST(created_at AS DATE) AS order_date, count(*) AS orders_count, CAST(sum(total_amount) AS DOUBLE) AS daily_revenue
FROM shop_orders GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def ord_recent_days(v: ShopViews) -> DataFrame:
    return paging.recent_days(daily_orders(v.orders), "order_date", "week")


@query("ord_recent", """
SELECT order_id, customer_id, order_status, created_at FROM shop_orders ORDER BY created_at DESC, order_id LIMIT 5""")
def ord_recent(v: ShopViews) -> DataFrame:
    return paging.recent(v.orders.select("order_id", "customer_id", "order_status", "created_at"), "created_at", "order_id", 5)


@query("ord_activity_feed", """
SELECT event_id, user_id, event_type, game_title, timestamp
FROM (SELECT event_id, user_id, event_type, game_title, timestamp FROM game_interactions)
ORDER BY timestamp DESC, event_id LIMIT 20""")
def ord_activity_feed(v: ShopViews) -> DataFrame:
    feed = v.game_interactions.select("event_id", "user_id", "event_type", "game_title", "timestamp")
    return paging.recent(feed, "timestamp", "event_id", 20)


@query("ord_customer_orders", """
SELECT order_id, order_status, CAST(total_amount AS DOUBLE) AS total_amount, payment_method, payment_status, created_at,
       (SELECT count(*) FROM shop_orders WHERE customer_id = (SELECT max(customer_id) FROM shop_orders)) AS total_items
FROM shop_orders WHERE customer_id = (SELECT max(customer_id) FROM shop_orders)
ORDER BY created_at DESC, order_id LIMIT 10""")
def ord_customer_orders(v: ShopViews) -> DataFrame:
    found = orders.customer_orders(v.orders, v.orders.agg(F.max("customer_id")).scalar())
    page = paging.paginate(found, [F.desc("created_at"), F.asc("order_id")], page=1, limit=10)
    return page.select(*found.columns, "total_items")
