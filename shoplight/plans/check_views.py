"""The logical shop tables as SQL common table expressions, for the check queries.

They state the same mapping as ``sources/shop_views.py``. The order table is called
``shop_orders`` here because ``orders`` names the raw table.
"""

from __future__ import annotations

import re

AS_OF = "(SELECT max(ts) FROM events)"

VIEWS = {
    "ev": """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS event_no,
       CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
       CAST(user_id AS VARCHAR) AS user_id, user_id AS user_no, ts AS timestamp, event_type AS kind, value, props,
       CAST(props->>'$.k' AS INTEGER) AS k
FROM events""",
    "some_anonymous": """
SELECT * REPLACE (CASE WHEN event_no % 7 <> 0 THEN user_id END AS user_id) FROM ev""",
    "game_events": """
SELECT ev.*, p_partkey AS game_id, p_name AS game_title, p_type AS game_category,
       CASE kind WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'checkout' ELSE kind END AS event_type
FROM ev JOIN part ON k = p_partkey""",
    "game_interactions": """
SELECT event_id, session_id, user_id, game_id, game_title, game_category, event_type, props AS event_data, timestamp
FROM game_events""",
    "purchase_events": """
SELECT event_id, session_id, user_id, 'order_' || event_id AS order_id, user_id AS customer_id, game_id, game_title,
       game_category, CAST(value AS DECIMAL(10,2)) AS total_amount, timestamp AS purchase_timestamp,
       event_type AS funnel_step, CASE WHEN k % 10 = 0 THEN 'pending' ELSE 'completed' END AS status
FROM game_events WHERE kind <> 'error'""",
    "page_views": """
SELECT event_id, session_id, user_id,
       CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/shop.html' WHEN 2 THEN '/product-details.html' WHEN 3 THEN '/contact.html'
            ELSE '/faq.html' END AS page_url,
       CASE k % 5 WHEN 0 THEN 'homepage' WHEN 1 THEN 'shop' WHEN 2 THEN 'product' WHEN 3 THEN 'contact'
            ELSE 'other' END AS page_category,
       timestamp, CAST(floor(value) AS BIGINT) AS time_on_page_seconds, least(100, k) AS scroll_depth_percentage,
       floor(value) < 10 AS bounce, CASE WHEN k % 4 = 0 THEN NULL ELSE 'search' END AS referrer
FROM ev WHERE kind IN ('view', 'click')""",
    "search_events": """
SELECT event_id, session_id, user_id, game_title AS search_query, game_category AS search_category, k AS results_count,
       CASE WHEN k % 3 = 0 THEN k % 10 + 1 END AS clicked_result_position, k = 0 AS no_results, timestamp
FROM game_events WHERE kind = 'view'""",
    "performance_metrics": """
SELECT event_id AS metric_id,
       CASE user_no % 4 WHEN 0 THEN 'frontend' WHEN 1 THEN 'game-service' WHEN 2 THEN 'order-service'
            ELSE 'analytics-service' END AS service_name,
       kind AS metric_type, value AS metric_value, timestamp
FROM ev""",
    "user_sessions": """
SELECT session_id, user_id,
       CASE user_no % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
       CASE user_no % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' ELSE 'Edge' END AS browser,
       n_name AS country, session_start_time, session_end_time, page_views,
       CAST((epoch_us(session_end_time) - epoch_us(session_start_time)) // 1000000 AS BIGINT) AS session_duration_seconds
FROM (SELECT session_id, user_id, user_no, min(timestamp) AS session_start_time, max(timestamp) AS session_end_time,
             count(*) AS page_views
      FROM ev GROUP BY session_id, user_id, user_no) s
LEFT JOIN nation ON s.user_no % 25 = n_nationkey""",
    "envelope_events": """
SELECT event_no, k, value, user_no, session_id AS session_id,
       CASE kind WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'game_interaction' WHEN 'signup' THEN 'search'
            WHEN 'error' THEN 'performance' ELSE kind END AS event_type,
       CASE WHEN k % 13 <> 0 THEN event_id END AS event_id,
       CASE WHEN k % 17 <> 0 THEN user_id END AS user_id,
       CASE WHEN k % 11 <> 0 THEN date_trunc('second', timestamp)
            ELSE date_trunc('second', (SELECT max(ts) FROM events)) END AS timestamp,
       CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/shop.html' WHEN 2 THEN '/product-details.html' WHEN 3 THEN '/contact.html'
            ELSE '/faq.html' END AS page_url
FROM ev""",
    "games": """
SELECT p_partkey AS game_id, p_name AS name, 'A ' || lower(p_type) || ' title by ' || p_brand AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE WHEN p_partkey % 3 = 0
            THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(10,2)) END AS discount_price,
       p_type AS category, string_split(p_name, ' ') AS tags,
       CAST((10 + p_size % 41) / 10.0 AS DECIMAL(3,2)) AS rating,
       p_partkey % 5 = 0 AS is_featured, p_partkey % 7 = 0 AS is_trending,
       CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS stock_quantity, p_brand AS publisher,
       CAST(DATE '2023-01-01' + CAST(p_partkey % 300 AS INTEGER) AS TIMESTAMP) AS created_at
FROM part""",
    "order_items": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS game_id, l_linenumber AS line_number,
       CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
       CASE WHEN l_discount > 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2))
            - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) END AS discount_price,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
            AS DECIMAL(12,2)) AS total_price,
       l_shipdate AS created_at
FROM lineitem""",
    "shop_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'shipped' ELSE 'delivered' END AS order_status,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'paypal'
            ELSE 'bank_transfer' END AS payment_method,
       CASE o_orderkey % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'pending' ELSE 'refunded' END AS payment_status,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey * 2 END AS shipping_address_id,
       o_custkey * 2 + 1 AS billing_address_id, o_orderdate AS created_at
FROM orders""",
    "customers": """
SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
       lower(c_name) || '@example.com' AS email, '+' || CAST(c_nationkey AS VARCHAR) AS phone
FROM customer""",
    "customer_addresses": """
SELECT c_custkey * 2 + kind_no AS address_id, c_custkey AS customer_id, address_type,
       c_name || ' street ' || address_type AS address_line_1, n_name AS city, r_name AS country
FROM customer CROSS JOIN (VALUES (0, 'shipping'), (1, 'billing')) kinds(kind_no, address_type)
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "game_reviews": """
SELECT l_orderkey * 10 + l_linenumber AS review_id, l_partkey AS game_id, o_custkey AS user_id,
       1 + l_linenumber % 5 AS rating, l_linestatus = 'F' AS is_verified_purchase, l_shipdate AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "order_ships": """
SELECT o_orderkey, o_orderstatus, o_orderdate, first_ship, last_ship
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
                       FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey""",
    "status_snapshots": """
SELECT o_orderkey AS order_id, 1 AS seq, 'pending' AS order_status, o_orderdate AS updated_at FROM order_ships
UNION ALL SELECT o_orderkey, 2, 'pending', o_orderdate + INTERVAL 1 HOUR FROM order_ships
UNION ALL SELECT o_orderkey, 3, 'shipped', first_ship FROM order_ships WHERE first_ship IS NOT NULL
UNION ALL SELECT o_orderkey, 4, 'shipped', first_ship + INTERVAL 1 HOUR FROM order_ships WHERE first_ship IS NOT NULL
UNION ALL SELECT o_orderkey, 5, 'delivered', last_ship FROM order_ships
          WHERE o_orderstatus = 'F' AND last_ship IS NOT NULL""",
    "game_stats": """
SELECT g.game_id, g.name, g.category, g.price, g.discount_price, round(avg(r.rating), 2) AS average_rating,
       count(r.review_id) AS review_count, CAST(sum(oi.quantity) AS BIGINT) AS total_sold, sum(oi.total_price) AS total_revenue
FROM games g LEFT JOIN game_reviews r ON g.game_id = r.game_id LEFT JOIN order_items oi ON g.game_id = oi.game_id
GROUP BY g.game_id, g.name, g.category, g.price, g.discount_price""",
    "customer_summary": """
SELECT c.customer_id, c.first_name, c.last_name, c.email, count(o.order_id) AS total_orders,
       CAST(sum(o.total_amount) AS DOUBLE) AS total_spent,
       CAST(sum(o.total_amount) AS DOUBLE) / count(o.total_amount) AS average_order_value,
       max(o.created_at) AS last_order_date
FROM customers c LEFT JOIN shop_orders o ON c.customer_id = o.customer_id
GROUP BY c.customer_id, c.first_name, c.last_name, c.email""",
    "scoreboard": """
SELECT i.game_id, i.game_title, i.game_category, i.views, i.purchases, i.conversion_rate,
       coalesce(p.revenue, 0) AS revenue, rank() OVER (ORDER BY i.views DESC) AS popularity_rank
FROM (SELECT game_id, game_title, game_category, count(*) FILTER (WHERE event_type = 'view') AS views,
             count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
             round(count(*) FILTER (WHERE event_type = 'purchase')
                   / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) * 100, 2) AS conversion_rate
      FROM game_interactions GROUP BY game_id, game_title, game_category) i
LEFT JOIN (SELECT game_id, sum(total_amount) AS revenue FROM purchase_events WHERE funnel_step = 'purchase'
           GROUP BY game_id) p ON i.game_id = p.game_id""",
    "priced_orders": """
SELECT order_id, 'pending' AS order_status, subtotal, round(subtotal * CAST(0.08 AS DECIMAL(3,2)), 2) AS tax_amount,
       CAST(CASE WHEN subtotal > 50 THEN 0 ELSE 5.99 END AS DECIMAL(18,2)) AS shipping_cost
FROM (SELECT order_id, CAST(sum(unit_price * quantity) AS DECIMAL(18,2)) AS subtotal FROM order_items GROUP BY order_id)""",
}


def rounded_mean_sql(column: str) -> str:
    """Mean of a positive two-digit decimal column rounded half up to cents, in integer arithmetic."""
    return (
        f"CAST((2 * CAST(sum({column}) * 100 AS HUGEINT) + count({column})) // (2 * count({column})) AS DOUBLE) / 100"
    )


def with_views(sql: str) -> str:
    """``sql`` behind a WITH clause that holds every view it names, directly or through another."""
    sql = sql.strip().replace("{as_of}", AS_OF)
    seen: set[str] = set()
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                add(body)
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    glue = f"WITH {ctes}\n"
    return glue + sql if not sql.upper().startswith("WITH ") else f"{glue.rstrip()},\n{sql[5:].lstrip()}"
