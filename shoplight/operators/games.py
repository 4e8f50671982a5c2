"""Game popularity, scoreboards and game revenue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplight.functions.scalars import distinct_count, percent
from shoplight.functions.times import trailing
from shoplight.operators.sequences import in_chunks

AsOf = dt.datetime | Column | None

# Fixed value: the best ranks that count as trending.
TRENDING_RANKS = 3


def _count_type(label: str) -> Column:
    return F.count_if(F.col("event_type") == label)


def game_popularity(
    interactions: DataFrame, length: str = "7 DAY", as_of: AsOf = None, limit: int = 20, approx: bool = False
) -> DataFrame:
    """Interactions, sessions, views, cart adds, purchases and conversion of the most popular games."""
    return (
        trailing(interactions, "timestamp", length, as_of)
        .groupBy("game_title", "game_category")
        .agg(
            F.count("*").alias("total_interactions"),
            distinct_count("session_id", approx).alias("unique_sessions"),
            _count_type("view").alias("views"),
            _count_type("add_to_cart").alias("cart_additions"),
            _count_type("purchase").alias("purchases"),
            percent(_count_type("purchase"), _count_type("view")).alias("conversion_rate"),
        )
        .orderBy(F.desc("total_interactions"), "game_title", "game_category")
        .limit(limit)
    )


def game_revenue_join(
    interactions: DataFrame, purchases: DataFrame, length: str = "7 DAY", as_of: AsOf = None
) -> DataFrame:
    """Interactions joined to all purchases of the same game, per title, most interactions first: the fan-out figures.

    Every interaction counts once per purchase of its game and every purchase once per
    interaction. These are products of per-game totals, so the pairs are never built.
    """
    per_game = (
        trailing(interactions, "timestamp", length, as_of)
        .groupBy("game_id", "game_title", "game_category")
        .agg(F.count("*").alias("n"), _count_type("purchase").alias("bought"))
    )
    sold = purchases.groupBy("game_id").agg(F.count("*").alias("sales"), F.sum("total_amount").alias("amount"))
    sessions = (
        trailing(interactions, "timestamp", length, as_of)
        .groupBy("game_title", "game_category").agg(F.count_distinct("session_id").alias("unique_sessions"))
    )
    partners = F.greatest(F.coalesce("sales", F.lit(0)), F.lit(1))
    totals = per_game.join(sold, "game_id", "left").groupBy("game_title", "game_category").agg(
        F.sum(F.col("n") * partners).alias("interactions"),
        F.sum(F.col("bought") * partners).alias("purchases"),
        F.sum(F.coalesce(F.col("amount") * F.col("n"), F.lit(0))).alias("revenue"),
    )
    same = totals["game_title"].eqNullSafe(sessions["game_title"])
    same &= totals["game_category"].eqNullSafe(sessions["game_category"])
    return totals.join(sessions, same, "left").select(
        totals["game_title"], totals["game_category"], "interactions", "unique_sessions", "purchases", "revenue"
    ).orderBy(F.desc("interactions"), "game_title", "game_category")


def game_revenue_dedup(
    interactions: DataFrame, purchases: DataFrame, length: str = "7 DAY", as_of: AsOf = None
) -> DataFrame:
    """Interactions and revenue per game, each side added up once."""
    per_game = (
        trailing(interactions, "timestamp", length, as_of)
        .groupBy("game_id", "game_title", "game_category")
        .agg(
            F.count("*").alias("interactions"),
            F.count_distinct("session_id").alias("unique_sessions"),
            _count_type("purchase").alias("purchases"),
        )
    )
    sold = purchases.groupBy("game_id").agg(F.sum("total_amount").alias("revenue"))
    return per_game.join(sold, "game_id", "left").withColumn("revenue", F.coalesce("revenue", F.lit(0)))


def game_scoreboard(interactions: DataFrame, purchases: DataFrame) -> DataFrame:
    """Views, purchases, conversion and revenue per game."""
    shown = interactions.groupBy("game_id", "game_title", "game_category").agg(
        _count_type("view").alias("views"),
        _count_type("purchase").alias("purchases"),
        percent(_count_type("purchase"), _count_type("view")).alias("conversion_rate"),
    )
    sold = (
        purchases.filter(F.col("funnel_step") == "purchase")
        .groupBy("game_id").agg(F.sum("total_amount").alias("revenue"))
    )
    return shown.join(sold, "game_id", "left").withColumn("revenue", F.coalesce("revenue", F.lit(0).cast("decimal(20,2)")))


def popularity_rank(scoreboard: DataFrame, by: str = "views") -> DataFrame:
    """Rank by views and a trend label: the first three ranks trend up.

    Games with the same count share a rank, so the rank is found once per distinct count. The counts are cut
    into ranges, added up inside each, and moved by the sum of the ranges above: no task orders them all.
    """
    counts = in_chunks(scoreboard.groupBy(by).agg(F.count("*").alias("_games")).withColumn("_down", -F.col(by)), ["_down"], "counts")
    whole = counts.groupBy("_chunk").agg(F.sum("_games").alias("_whole"))
    above = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = whole.select("_chunk", F.coalesce(F.sum("_whole").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_chunk").orderBy("_down").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_higher", F.coalesce(F.sum("_games").over(inside), F.lit(0))).join(offsets, "_chunk").select(
        by, (F.col("_higher") + F.col("_above") + 1).alias("popularity_rank"))
    trend = F.when(F.col("popularity_rank") <= TRENDING_RANKS, "trending_up").otherwise("stable")
    return scoreboard.join(ranks, by, "left").withColumn("popularity_trend", trend)


def leaderboard(
    scoreboard: DataFrame, sort_by: str = "popularity", category: str | None = None, limit: int = 10
) -> DataFrame:
    """Top games by revenue, views, conversion or popularity, in one category or all."""
    chosen = scoreboard if category is None else scoreboard.filter(F.lower("game_category") == category.lower())
    order = {
        "revenue": F.desc("revenue"), "views": F.desc("views"), "conversion": F.desc_nulls_last("conversion_rate"),
    }.get(sort_by, F.asc("popularity_rank"))
    return chosen.orderBy(order, "game_id").limit(limit)


def export_interactions(
    interactions: DataFrame, length: str = "30 DAY", as_of: AsOf = None, value_path: str = "$.interaction_value"
) -> DataFrame:
    """Daily interactions by game and type, with purchase revenue read from the event's JSON, for export: newest day and most interactions first."""
    value = F.coalesce(F.get_json_object("event_data", value_path).try_cast("decimal(18,2)"), F.lit(0))
    return (
        trailing(interactions, "timestamp", length, as_of)
        .groupBy(
            F.to_date("timestamp").alias("date"), "game_id", "game_title", "game_category",
            F.col("event_type").alias("interaction_type"),
        )
        .agg(
            F.count("*").alias("interactions"),
            F.count_distinct("session_id").alias("unique_sessions"),
            F.sum(F.when(F.col("event_type") == "purchase", value).otherwise(0)).alias("revenue"),
        )
        .orderBy(F.desc("date"), F.desc("interactions"), "game_id", "game_title", "game_category", "interaction_type")
    )
