"""Event intake, over request bodies packed from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.functions.scalars import event_time, page_category
from shoplight.functions.times import moment
from shoplight.operators import ingest
from shoplight.plans.registry import query
from shoplight.sources.shop_views import ShopViews


def _events(v: ShopViews) -> DataFrame:
    return ingest.explode_batch(v.batch_envelopes)


@query("ing_explode_batch", """
SELECT event_type, session_id, count(*) AS event_count, 0 AS rejected_bodies FROM envelope_events GROUP BY 1, 2
UNION ALL
SELECT 'rejected', '', 0, count(*) FROM events WHERE event_id % 500 = 0""")
def ing_explode_batch(v: ShopViews) -> DataFrame:
    accepted = _events(v).groupBy("event_type", "session_id").agg(
        F.count("*").alias("event_count"), F.lit(0).cast("bigint").alias("rejected_bodies")
    )
    refused = ingest.rejected_batches(v.batch_envelopes).agg(F.count("*").alias("rejected_bodies")).select(
        F.lit("rejected").alias("event_type"), F.lit("").alias("session_id"),
        F.lit(0).cast("bigint").alias("event_count"), "rejected_bodies",
    )
    return accepted.unionByName(refused)


@query("ing_normalise_single", """
SELECT CASE kind WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'game_interaction' WHEN 'signup' THEN 'search'
            WHEN 'error' THEN 'performance' ELSE kind END AS event_type,
       session_id, user_id, CAST(k AS BIGINT) AS game_id,
       CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '/shop.html' ELSE '/product-details.html' END AS page_url,
       CAST(floor(value) AS BIGINT) AS time_on_page_seconds, 'view' AS interaction_type,
       'game ' || CAST(k AS VARCHAR) AS search_query, value AS metric_value,
       date_trunc('second', timestamp) AS timestamp
FROM ev WHERE k % 10 <> 9""")
def ing_normalise_single(v: ShopViews) -> DataFrame:
    rows = ingest.normalise_single(v.single_envelopes)
    return rows.select(
        "event_type", "session_id", "user_id", "game_id", "page_url", "time_on_page_seconds", "interaction_type",
        "search_query", "metric_value",
        event_time(F.col("timestamp"), moment(v.newest_event())).alias("timestamp"),
    )


@query("ing_reject_single", "SELECT event_no FROM ev WHERE k % 10 = 9")
def ing_reject_single(v: ShopViews) -> DataFrame:
    return ingest.rejected_singles(v.single_envelopes).select("event_no")


@query("ing_timestamp", """
SELECT session_id, event_type, timestamp, count(*) AS event_count FROM envelope_events GROUP BY 1, 2, 3""")
def ing_timestamp(v: ShopViews) -> DataFrame:
    at = event_time(F.col("timestamp"), moment(v.newest_event())).alias("timestamp")
    return _events(v).groupBy("session_id", "event_type", at).agg(F.count("*").alias("event_count"))


@query("ing_defaults", """
SELECT event_type, count(*) AS events, count(user_id) AS users_known,
       CAST(sum(CASE WHEN k % 7 <> 0 THEN floor(value) ELSE 0 END) AS BIGINT) AS seconds_sum,
       count(CASE WHEN k % 4 <> 0 THEN 1 END) AS clicked_known,
       count(CASE WHEN k % 6 <> 0 THEN 1 END) AS referrer_known
FROM envelope_events GROUP BY event_type""")
def ing_defaults(v: ShopViews) -> DataFrame:
    rows = _events(v)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.count(F.nullif("user_id", F.lit(""))).alias("users_known"),
        F.sum(ingest.number_or_zero("time_on_page_seconds")).alias("seconds_sum"),
        F.count(F.nullif("clicked_result_position", F.lit(0))).alias("clicked_known"),
        F.count_if(ingest.text_or("referrer", "") != "").alias("referrer_known"),
    )


@query("ing_page_views", """
SELECT event_id, session_id, user_id, timestamp, page_url,
       CAST(CASE WHEN k % 7 <> 0 THEN floor(value) ELSE 0 END AS BIGINT) AS time_on_page_seconds,
       k + 20 AS scroll_depth_percentage, false AS exit_page, false AS bounce,
       CASE WHEN k % 6 <> 0 THEN 'search' ELSE '' END AS referrer
FROM envelope_events WHERE event_type = 'page_view' AND event_id IS NOT NULL
UNION ALL
SELECT 'made up', session_id, user_id, timestamp, page_url,
       CAST(CASE WHEN k % 7 <> 0 THEN floor(value) ELSE 0 END AS BIGINT), k + 20, false, false,
       CASE WHEN k % 6 <> 0 THEN 'search' ELSE '' END
FROM envelope_events WHERE event_type = 'page_view' AND event_id IS NULL""")
def ing_page_views(v: ShopViews) -> DataFrame:
    rows = ingest.route_page_views(_events(v), v.newest_event())
    return rows.select(
        F.when(F.length("event_id") == 64, "made up").otherwise(F.col("event_id")).alias("event_id"),
        "session_id", "user_id", "timestamp", "page_url", "time_on_page_seconds", "scroll_depth_percentage",
        "exit_page", "bounce", "referrer",
    )


@query("ing_game_interactions", """
SELECT session_id, user_id, timestamp, CAST(k AS BIGINT) AS game_id,
       CASE WHEN k % 3 = 0 THEN 'view' ELSE 'purchase' END AS event_type,
       CASE WHEN k % 5 <> 0 THEN '{"interaction_value":"' || CAST(value AS VARCHAR) || '"}' ELSE '{}' END AS event_data,
       '' AS page_context
FROM envelope_events WHERE event_type = 'game_interaction'""")
def ing_game_interactions(v: ShopViews) -> DataFrame:
    rows = ingest.route_game_interactions(_events(v), v.newest_event())
    return rows.select("session_id", "user_id", "timestamp", "game_id", "event_type", "event_data", "page_context")


@query("ing_searches", """
SELECT session_id, user_id, timestamp, 'game ' || CAST(k AS VARCHAR) AS search_query,
       CAST(k % 10 AS BIGINT) AS results_count, nullif(k % 4, 0) AS clicked_result_position, false AS no_results
FROM envelope_events WHERE event_type = 'search'""")
def ing_searches(v: ShopViews) -> DataFrame:
    rows = ingest.route_searches(_events(v), v.newest_event())
    return rows.select(
        "session_id", "user_id", "timestamp", "search_query", "results_count", "clicked_result_position", "no_results"
    )


@query("ing_performance", """
SELECT CASE WHEN event_id IS NULL THEN 'made up' ELSE event_id END AS metric_id,
       CASE user_no % 4 WHEN 0 THEN 'frontend' WHEN 1 THEN 'game-service' WHEN 2 THEN 'order-service'
            ELSE 'analytics-service' END AS service_name,
       'response_time' AS metric_type, value AS metric_value, '' AS unit,
       CASE WHEN k % 2 = 0 THEN 200 END AS status_code, timestamp
FROM envelope_events WHERE event_type = 'performance'""")
def ing_performance(v: ShopViews) -> DataFrame:
    rows = ingest.route_performance(_events(v), v.newest_event())
    return rows.select(
        F.when(F.length("metric_id") == 64, "made up").otherwise(F.col("metric_id")).alias("metric_id"),
        "service_name", "metric_type", "metric_value", "unit", "status_code", "timestamp",
    )


@query("ing_quarantine", """
SELECT session_id, event_type, count(*) AS event_count FROM envelope_events WHERE event_type = 'purchase'
GROUP BY session_id, event_type""")
def ing_quarantine(v: ShopViews) -> DataFrame:
    return ingest.route_unknown(_events(v)).groupBy("session_id", "event_type").agg(F.count("*").alias("event_count"))


@query("ing_receipt", """
SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'page_view') AS page_views,
       count(*) FILTER (WHERE event_type = 'game_interaction') AS game_interactions,
       count(*) FILTER (WHERE event_type = 'search') AS search_events,
       count(*) FILTER (WHERE event_type = 'performance') AS performance_metrics,
       count(*) FILTER (WHERE event_type = 'purchase') AS quarantined, CAST(0 AS BIGINT) AS misfits
FROM envelope_events""")
def ing_receipt(v: ShopViews) -> DataFrame:
    return ingest.ingest_receipt(_events(v))


@query("ing_page_category", """
SELECT url, CASE WHEN url IN ('/', '/index.html') THEN 'homepage' WHEN contains(url, 'shop') THEN 'shop'
                 WHEN contains(url, 'product-details') THEN 'product' WHEN contains(url, 'contact') THEN 'contact'
                 ELSE 'other' END AS page_category, count(*) AS page_count
FROM (SELECT page_url AS url FROM page_views UNION ALL SELECT url FROM pages) GROUP BY 1, 2""")
def ing_page_category(v: ShopViews) -> DataFrame:
    urls = v.page_views.select(F.col("page_url").alias("url")).unionByName(v.base("pages").select("url"))
    return urls.groupBy("url", page_category(F.col("url")).alias("page_category")).agg(F.count("*").alias("page_count"))


@query("ing_flags", """
SELECT event_id, page_category, time_on_page_seconds < 10 AS bounce, coalesce(referrer, 'direct') AS referrer,
       least(100, scroll_depth_percentage * 2) AS scroll_depth_percentage
FROM page_views""")
def ing_flags(v: ShopViews) -> DataFrame:
    doubled = v.page_views.withColumn("scroll_depth_percentage", F.col("scroll_depth_percentage") * 2)
    return ingest.derive_flags(doubled).select(
        "event_id", "page_category", "bounce", "referrer", "scroll_depth_percentage"
    )


@query("ing_event_id", """
SELECT event_type, count(*) AS events, count(event_id) AS given_ids, count(*) - count(event_id) AS made_ids
FROM envelope_events GROUP BY event_type""")
def ing_event_id(v: ShopViews) -> DataFrame:
    rows = ingest.ensure_event_id(_events(v))
    return rows.groupBy("event_type").agg(
        F.count("event_id").alias("events"),
        F.count_if(F.length("event_id") < 64).alias("given_ids"),
        F.count_if(F.length("event_id") == 64).alias("made_ids"),
    )


@query("ing_odd_values", """
SELECT event_id, CASE WHEN k % 8 IN (0, 3) THEN 'quarantine' WHEN k % 8 IN (5, 6) THEN 'game_interactions' ELSE 'page_views' END AS target,
       CASE WHEN k % 8 <> 4 THEN session_id END AS session_id,
       CASE WHEN k % 8 = 1 THEN k WHEN k % 8 IN (0, 3, 5, 6) THEN NULL ELSE 0 END AS seconds,
       CASE k % 8 WHEN 5 THEN CAST(k AS VARCHAR) WHEN 6 THEN 'text' END AS inner_value,
       CASE WHEN k % 8 NOT IN (0, 3) THEN date_trunc('second', timestamp) END AS timestamp,
       CASE k % 8 WHEN 0 THEN 'time_on_page_seconds=' || k || '.7' WHEN 3 THEN 'timestamp=garbage' END AS misfit
FROM ev""")
def ing_odd_values(v: ShopViews) -> DataFrame:
    """Fractions, numbers as texts, other forms of time, event data as an object and as text, missing sessions."""
    k, part = F.col("k"), F.col("k") % 8
    time = F.when(part == 2, F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string")).when(part == 3, '"garbage"').otherwise(
        F.concat(F.lit('"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"')))
    body = F.concat(
        F.lit('{"events": [{"event_id": "'), "event_id", F.lit('", "event_type": "'),
        F.when(part.isin(5, 6), "game_interaction").otherwise("page_view"), F.lit('", "timestamp": '), time,
        F.when(part != 4, F.concat(F.lit(', "session_id": "'), "session_id", F.lit('"'))).otherwise(', "session_id": null'),
        F.when(part == 0, F.concat(F.lit(', "time_on_page_seconds": '), k, F.lit(".7")))
        .when(part == 1, F.concat(F.lit(', "time_on_page_seconds": "'), k, F.lit('"')))
        .when(part == 5, F.concat(F.lit(', "event_data": {"a": 1, "b": {"c": '), k, F.lit("}}")))
        .when(part == 6, F.lit(', "event_data": "{\\"b\\": {\\"c\\": \\"text\\"}}"')).otherwise(""),
        F.lit("}]}"))
    events = ingest.explode_batch(v.ev.select(body.alias("body")))
    received = v.newest_event()
    none = lambda kind: F.lit(None).cast(kind)
    views = ingest.route_page_views(events, received).select(
        "event_id", F.lit("page_views").alias("target"), "session_id", F.col("time_on_page_seconds").cast("int").alias("seconds"),
        none("string").alias("inner_value"), "timestamp", none("string").alias("misfit"))
    games = ingest.route_game_interactions(events, received).select(
        "event_id", F.lit("game_interactions"), "session_id", none("int"), F.get_json_object("event_data", "$.b.c"), "timestamp", none("string"))
    first = F.element_at("misfits", 1)
    rest = ingest.route_unknown(events).select(
        "event_id", F.lit("quarantine"), "session_id", none("int"), none("string"), none("timestamp"),
        F.concat_ws("=", first["field"], first["value"]))
    return views.unionAll(games).unionAll(rest)
