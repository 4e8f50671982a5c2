"""Ordered sequences, ranks and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.operators import catalogue, funnel, games, sequences, traffic
from shoplight.plans.metrics import FUNNEL
from shoplight.plans.registry import query
from shoplight.session import stored
from shoplight.sources.shop_views import ShopViews


@query("win_funnel_rates", f"""
WITH steps AS ({FUNNEL}),
     placed AS (SELECT *, CASE funnel_step WHEN 'view' THEN 1 WHEN 'add_to_cart' THEN 2 WHEN 'checkout' THEN 3
                                           WHEN 'purchase' THEN 4 ELSE 5 END AS pos FROM steps),
     rated AS (SELECT funnel_step, step_count, unique_sessions, revenue,
                      coalesce(round(step_count / lag(step_count) OVER (ORDER BY pos, funnel_step) * 100, 2), 100.0) AS conversion_rate
               FROM placed)
SELECT *, round(100.0 - conversion_rate, 2) AS drop_off_rate FROM rated""")
def win_funnel_rates(v: ShopViews) -> DataFrame:
    return funnel.funnel_rates(funnel.conversion_funnel(v.purchase_events, "7 DAY", v.newest_event()))


@query("win_popularity_rank", """
SELECT game_id, game_title, views, popularity_rank,
       CASE WHEN popularity_rank <= 3 THEN 'trending_up' ELSE 'stable' END AS popularity_trend
FROM scoreboard""")
def win_popularity_rank(v: ShopViews) -> DataFrame:
    board = games.popularity_rank(stored(games.game_scoreboard(v.game_interactions, v.purchase_events), "scoreboard"))
    return board.select("game_id", "game_title", "views", "popularity_rank", "popularity_trend")


@query("win_share", """
SELECT 'device' AS breakdown, device_type AS label, count(DISTINCT user_id) AS amount,
       round(count(DISTINCT user_id) * 100.0 / sum(count(DISTINCT user_id)) OVER (), 1) AS percentage
FROM user_sessions GROUP BY device_type
UNION ALL
SELECT 'browser', browser, count(DISTINCT user_id),
       round(count(DISTINCT user_id) * 100.0 / sum(count(DISTINCT user_id)) OVER (), 1)
FROM user_sessions GROUP BY browser
UNION ALL
SELECT 'page', page_url, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (), 1) FROM page_views GROUP BY page_url
UNION ALL
SELECT 'category', game_category, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (), 1)
FROM game_interactions GROUP BY game_category""")
def win_share(v: ShopViews) -> DataFrame:
    users = F.count_distinct("user_id")
    parts = [
        ("device", traffic.share_of_total(v.user_sessions, "device_type", users)),
        ("browser", traffic.share_of_total(v.user_sessions, "browser", users)),
        ("page", traffic.share_of_total(v.page_views, "page_url")),
        ("category", traffic.share_of_total(v.game_interactions, "game_category")),
    ]
    rows = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("breakdown"), F.col(part.columns[0]).alias("label"), "amount", "percentage")
        rows = part if rows is None else rows.unionAll(part)
    return rows


@query("win_behavior_flow", """
SELECT event_id, session_id, kind, timestamp, row_number() OVER w AS step_number,
       CAST(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) // 1000000, 0) AS BIGINT) AS time_since_previous_step_seconds
FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)""")
def win_behavior_flow(v: ShopViews) -> DataFrame:
    return sequences.behavior_flow(v.ev.select("event_id", "session_id", "kind", "timestamp"))


@query("win_behavior_flow_split", """
SELECT event_id, session_id, kind, timestamp, row_number() OVER w AS step_number,
       CAST(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) // 1000000, 0) AS BIGINT) AS time_since_previous_step_seconds
FROM (SELECT event_id, 'u' || user_id AS session_id, kind, timestamp FROM ev)
WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)""")
def win_behavior_flow_split(v: ShopViews) -> DataFrame:
    """One long sequence per user, so that sequences lie in several chunks."""
    rows = v.ev.select("event_id", F.concat(F.lit("u"), "user_id").alias("session_id"), "kind", "timestamp")
    return sequences.behavior_flow(rows)


@query("win_behavior_flow_hot", """
SELECT event_id, session_id, kind, timestamp,
       CASE WHEN session_id IS NULL THEN 1 ELSE row_number() OVER w END AS step_number,
       CASE WHEN session_id IS NULL THEN 0 ELSE
            CAST(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) // 1000000, 0) AS BIGINT) END AS time_since_previous_step_seconds
FROM (SELECT event_id, kind, CASE event_no % 3 WHEN 0 THEN 'hot' WHEN 1 THEN session_id END AS session_id,
             CASE WHEN event_no % 3 = 0 THEN (SELECT max(ts) FROM events) ELSE timestamp END AS timestamp FROM ev)
WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)""")
def win_behavior_flow_hot(v: ShopViews) -> DataFrame:
    """A third of the rows is one session at one instant, another third has none."""
    third = F.col("event_no") % 3
    newest = v.newest_event()
    rows = v.ev.select(
        "event_id", F.when(third == 0, "hot").when(third == 1, F.col("session_id")).alias("session_id"), "kind",
        F.when(third == 0, newest).otherwise(F.col("timestamp")).alias("timestamp"))
    return sequences.behavior_flow(rows)


def sessions_sql(gap: str, events: str) -> str:
    return f"""
SELECT user_id, anonymous_session, session_number, min(timestamp) AS session_start_time, max(timestamp) AS session_end_time,
       count(*) AS page_views, CAST((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000000 AS BIGINT) AS session_duration_seconds
FROM (SELECT user_id, anonymous_session, timestamp, CAST(sum(is_new) OVER (PARTITION BY user_id, anonymous_session ORDER BY timestamp, event_id) AS BIGINT) AS session_number
      FROM (SELECT user_id, anonymous_session, event_id, timestamp,
                   CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id, anonymous_session ORDER BY timestamp, event_id) <= INTERVAL {gap}
                        THEN 0 ELSE 1 END AS is_new
            FROM (SELECT *, CASE WHEN user_id IS NULL THEN session_id END AS anonymous_session FROM {events})))
GROUP BY user_id, anonymous_session, session_number"""


@query("win_sessionise", sessions_sql("30 MINUTE", "some_anonymous"))
def win_sessionise(v: ShopViews) -> DataFrame:
    return sequences.sessionise(v.some_anonymous, "30 MINUTE")


@query("win_sessionise_6h", sessions_sql("6 HOUR", "ev"))
def win_sessionise_6h(v: ShopViews) -> DataFrame:
    return sequences.sessionise(v.ev, "6 HOUR")


@query("win_visits", """
WITH seen AS (SELECT *, lag(page_url) OVER w AS before, row_number() OVER w AS no FROM page_views
              WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)),
     starts AS (SELECT * FROM seen WHERE no = 1 OR page_url IS DISTINCT FROM before)
SELECT session_id, user_id, event_id, row_number() OVER w AS visit_number, page_url, lag(page_url) OVER w AS previous_page,
       timestamp, lead(timestamp) OVER w IS NULL AS exit_page,
       CAST(coalesce((epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) // 1000000, time_on_page_seconds) AS BIGINT) AS time_on_page_seconds
FROM starts WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)""")
def win_visits(v: ShopViews) -> DataFrame:
    return sequences.enrich_visits(v.page_views)


@query("win_conversion_time", """
SELECT p.event_id, p.session_id, p.purchase_timestamp,
       CASE WHEN first_view <= purchase_timestamp
            THEN CAST((epoch_us(purchase_timestamp) - epoch_us(first_view)) // 1000000 AS BIGINT) END AS conversion_time_seconds
FROM purchase_events p
LEFT JOIN (SELECT session_id, min(purchase_timestamp) AS first_view FROM purchase_events WHERE funnel_step = 'view'
           GROUP BY session_id) f ON p.session_id = f.session_id
WHERE p.funnel_step = 'purchase'""")
def win_conversion_time(v: ShopViews) -> DataFrame:
    return sequences.conversion_time(v.purchase_events)


@query("win_latest_reviews", """
SELECT game_id, review_id, user_id, rating, created_at, CAST(position AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created_at DESC, review_id) AS position FROM game_reviews)
WHERE position <= 5""")
def win_latest_reviews(v: ShopViews) -> DataFrame:
    return catalogue.latest_reviews(v.game_reviews).select(
        "game_id", "review_id", "user_id", "rating", "created_at", "position"
    )


@query("win_growth", """
SELECT date, users, lag(users) OVER (ORDER BY date) AS previous_value,
       round((users - lag(users) OVER (ORDER BY date)) / lag(users) OVER (ORDER BY date) * 100, 2) AS growth_rate
FROM (SELECT CAST(timestamp AS DATE) AS date, count(DISTINCT user_id) AS users FROM ev GROUP BY 1)""")
def win_growth(v: ShopViews) -> DataFrame:
    daily = v.ev.groupBy(F.to_date("timestamp").alias("date")).agg(F.count_distinct("user_id").alias("users"))
    return sequences.growth_rate(daily, "date", "users")


@query("win_status_history", """
SELECT order_id, before AS previous_status, order_status AS new_status, 'Status updated' AS status_reason,
       'system' AS changed_by, updated_at AS created_at
FROM (SELECT *, lag(order_status) OVER w AS before, row_number() OVER w AS no FROM status_snapshots
      WINDOW w AS (PARTITION BY order_id ORDER BY updated_at, seq))
WHERE no > 1 AND order_status IS DISTINCT FROM before""")
def win_status_history(v: ShopViews) -> DataFrame:
    return sequences.status_history(v.status_snapshots)


@query("win_latest_state", """
SELECT order_id, seq, order_status, updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, seq DESC) AS no FROM status_snapshots)
WHERE no = 1""")
def win_latest_state(v: ShopViews) -> DataFrame:
    return sequences.latest_by_key(v.status_snapshots, ["order_id"], ["updated_at", "seq"])
