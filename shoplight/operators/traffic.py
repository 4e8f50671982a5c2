"""Page traffic, sessions, searches and users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplight.functions.scalars import distinct_count, percent
from shoplight.functions.times import bucket, start_of, trailing

AsOf = dt.datetime | Column | None


def traffic_by(page_views: DataFrame, unit: str, name: str, approx: bool = False) -> DataFrame:
    """Views, sessions, users and mean time on page per time bucket."""
    return page_views.groupBy(bucket("timestamp", unit).alias(name)).agg(
        F.count("*").alias("page_views"),
        distinct_count("session_id", approx).alias("unique_sessions"),
        distinct_count("user_id", approx).alias("unique_users"),
        F.avg("time_on_page_seconds").alias("avg_time_on_page"),
    )


def realtime_metrics(
    page_views: DataFrame, length: str = "1 HOUR", as_of: AsOf = None, limit: int = 60, approx: bool = False
) -> DataFrame:
    """Traffic per minute over a trailing range: the newest ``limit`` minutes."""
    minutes = traffic_by(trailing(page_views, "timestamp", length, as_of), "minute", "minute", approx)
    return minutes.orderBy(F.desc("minute")).limit(limit)


def hourly_traffic(page_views: DataFrame, length: str = "24 HOUR", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Traffic per hour over a trailing range, newest first."""
    recent = trailing(page_views, "timestamp", length, as_of)
    return traffic_by(recent, "hour", "hour", approx).drop("avg_time_on_page").orderBy(F.desc("hour"))


def views_by_hours_of_day(page_views: DataFrame, hours: int = 4) -> DataFrame:
    """Page views per block of hours of the day."""
    block = (F.floor(F.hour("timestamp") / hours) * hours).cast("int")
    return page_views.groupBy(block.alias("hour_of_day")).agg(F.count("*").alias("page_views"))


def active_users_by_hours_of_day(page_views: DataFrame, hours: int = 2, approx: bool = False) -> DataFrame:
    """Distinct users per block of hours of the day."""
    block = (F.floor(F.hour("timestamp") / hours) * hours).cast("int")
    return page_views.groupBy(block.alias("hour_of_day")).agg(distinct_count("user_id", approx).alias("active_users"))


def user_behavior(sessions: DataFrame, length: str = "7 DAY", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Sessions, users, mean duration, mean pages and bounces per day, newest first."""
    recent = trailing(sessions, "session_start_time", length, as_of)
    bounces = F.count_if(F.col("page_views") == 1)
    return (
        recent.groupBy(F.to_date("session_start_time").alias("date"))
        .agg(
            F.count("*").alias("total_sessions"),
            distinct_count("user_id", approx).alias("unique_users"),
            F.avg("session_duration_seconds").alias("avg_session_duration"),
            F.avg("page_views").alias("avg_pages_per_session"),
            bounces.alias("bounce_sessions"),
            percent(bounces, F.count("*")).alias("bounce_rate"),
        )
        .orderBy(F.desc("date"))
    )


def search_analytics(
    searches: DataFrame, length: str = "7 DAY", as_of: AsOf = None, limit: int = 20, approx: bool = False
) -> DataFrame:
    """Count, searchers, mean results, empty results, clicks and click-through rate of the top searches."""
    clicks = F.count_if(F.col("clicked_result_position").isNotNull())
    return (
        trailing(searches, "timestamp", length, as_of)
        .groupBy("search_query")
        .agg(
            F.count("*").alias("search_count"),
            distinct_count("session_id", approx).alias("unique_searchers"),
            F.avg("results_count").alias("avg_results"),
            F.count_if("no_results").alias("no_results_count"),
            clicks.alias("clicks"),
            percent(clicks, F.count("*")).alias("click_through_rate"),
        )
        .orderBy(F.desc("search_count"), "search_query")
        .limit(limit)
    )


def search_totals(top_searches: DataFrame) -> DataFrame:
    """Totals over the searches that the top list keeps."""
    return top_searches.agg(
        F.coalesce(F.sum("search_count"), F.lit(0)).alias("total_searches"),
        F.coalesce(F.sum("unique_searchers"), F.lit(0)).alias("total_unique_searchers"),
    )


def recent_activity_probe(minutes: DataFrame) -> DataFrame:
    """Views and sessions of the newest minute and the number of minutes with traffic."""
    return minutes.agg(
        F.coalesce(F.max_by("page_views", "minute"), F.lit(0)).alias("last_hour_page_views"),
        F.coalesce(F.max_by("unique_sessions", "minute"), F.lit(0)).alias("unique_sessions"),
        F.count("*").alias("data_points"),
    )


def dashboard_summary(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """Dashboard headline from the per-minute and per-day results, added up as the dashboard does.

    Distinct counts are summed over minutes and daily means are averaged without weights;
    ``dashboard_summary_exact`` gives the true figures.
    """
    means = days.agg(F.struct(F.avg("avg_session_duration").alias("duration"), F.avg("bounce_rate").alias("bounces")))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return minutes.agg(
        total("page_views").alias("total_page_views"),
        total("unique_sessions").alias("total_sessions"),
        total("unique_users").alias("total_users"),
    ).withColumn("_means", means.scalar()).select(
        "total_page_views", "total_sessions", "total_users",
        F.coalesce("_means.duration", F.lit(0.0)).alias("avg_session_duration"),
        F.coalesce("_means.bounces", F.lit(0.0)).alias("bounce_rate"),
    )


def dashboard_summary_exact(
    page_views: DataFrame, sessions: DataFrame, view_length: str = "24 HOUR", session_length: str = "7 DAY",
    as_of: AsOf = None, approx: bool = False,
) -> DataFrame:
    """Dashboard headline with true distinct counts and means weighted by session."""
    bounced = F.avg((F.col("page_views") == 1).cast("double")) * 100
    means = trailing(sessions, "session_start_time", session_length, as_of).agg(
        F.struct(F.avg("session_duration_seconds").alias("duration"), bounced.alias("bounces"))
    )
    return trailing(page_views, "timestamp", view_length, as_of).agg(
        F.count("*").alias("total_page_views"),
        distinct_count("session_id", approx).alias("total_sessions"),
        distinct_count("user_id", approx).alias("total_users"),
    ).withColumn("_means", means.scalar()).select(
        "total_page_views", "total_sessions", "total_users",
        F.coalesce("_means.duration", F.lit(0.0)).alias("avg_session_duration"),
        F.round(F.coalesce("_means.bounces", F.lit(0.0)), 2).alias("bounce_rate"),
    )


def user_counts(events: DataFrame, period: str = "7 DAY", as_of: AsOf = None) -> DataFrame:
    """New, returning, active and total users; active users have an event in the period. Anonymous events count for none."""
    start = start_of(events, "timestamp", period, as_of)
    seen = events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return seen.agg(
        F.count("*").alias("total_users"),
        F.count_if(F.col("last") >= start).alias("active_users"),
        F.count_if(F.col("first") >= start).alias("new_users"),
        F.count_if((F.col("last") >= start) & (F.col("first") < start)).alias("returning_users"),
    )


def export_page_views(page_views: DataFrame, length: str = "30 DAY", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Daily page views by category, for export."""
    return (
        trailing(page_views, "timestamp", length, as_of)
        .groupBy(F.to_date("timestamp").alias("date"), "page_category")
        .agg(
            F.count("*").alias("page_views"),
            distinct_count("session_id", approx).alias("unique_sessions"),
            distinct_count("user_id", approx).alias("unique_users"),
            F.avg("time_on_page_seconds").alias("avg_time_on_page"),
            F.avg("scroll_depth_percentage").alias("avg_scroll_depth"),
        )
        .orderBy(F.desc("date"), "page_category")
    )


def export_sessions(sessions: DataFrame, length: str = "30 DAY", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Daily sessions by device, browser and country, for export."""
    return (
        trailing(sessions, "session_start_time", length, as_of)
        .groupBy(F.to_date("session_start_time").alias("date"), "device_type", "browser", "country")
        .agg(
            F.count("*").alias("sessions"),
            distinct_count("user_id", approx).alias("unique_users"),
            F.avg("session_duration_seconds").alias("avg_session_duration"),
            F.avg("page_views").alias("avg_pages_per_session"),
        )
        .orderBy(F.desc("date"), "device_type", "browser", "country")
    )


def views_by_category(export: DataFrame) -> DataFrame:
    """Exported page views added up by category."""
    return export.groupBy("page_category").agg(F.sum("page_views").alias("page_views"))


def share_of_total(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Amount and share in percent per key; the total is one scalar, not a window over all keys."""
    amounts = df.groupBy(key).agg((F.count("*") if weight is None else weight).alias("amount"))
    total = amounts.agg(F.sum("amount")).scalar()
    return amounts.withColumn("percentage", F.round(F.col("amount") * 100.0 / total, 1))
