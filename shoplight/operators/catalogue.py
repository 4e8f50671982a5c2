"""The game catalogue: filters, search, statistics and game pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplight.functions.stems import same_stem, stem
from shoplight.operators.sequences import newest_per_key


def filter_games(
    games: DataFrame, category: str | None = None, min_price: Decimal | str | None = None,
    max_price: Decimal | str | None = None, featured: bool = False, trending: bool = False,
) -> DataFrame:
    """Games that pass every given condition."""
    conditions: list[Column] = []
    if category:
        conditions.append(F.col("category").ilike(f"%{category}%"))
    if min_price:
        conditions.append(F.col("price") >= F.lit(Decimal(min_price)))
    if max_price:
        conditions.append(F.col("price") <= F.lit(Decimal(max_price)))
    if featured:
        conditions.append(F.col("is_featured"))
    if trending:
        conditions.append(F.col("is_trending"))
    return reduce(DataFrame.filter, conditions, games)


def eq_ci(df: DataFrame, columns: Sequence[str], value: str | None) -> DataFrame:
    """Rows where any of the columns equals ``value`` whatever the case.

    Nothing, ``*`` and ``all`` pass every row; one leading dot is dropped.
    """
    if not value or value == "*" or value.lower() == "all":
        return df
    wanted = value.removeprefix(".").lower()
    return df.filter(reduce(Column.__or__, [F.lower(c) == wanted for c in columns]))


def in_stock(games: DataFrame, flag: bool | None = None) -> DataFrame:
    """Games in stock, out of stock, or all of them."""
    return games if flag is None else games.filter((F.col("stock_quantity") > 0) == flag)


def games_in_category(games: DataFrame, category: str) -> DataFrame:
    """Games whose category holds the text; page it with ``CATEGORY_ORDER``."""
    return games.filter(F.col("category").ilike(f"%{category}%"))


def category_order() -> list[Column]:
    """Best rating first, then name."""
    return [F.desc_nulls_first("rating"), F.asc("name"), F.asc("game_id")]


# The English stop words of the database's text search, in natural order.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should "
    "now".split()
)


def trending_by_category(games: DataFrame, categories: Sequence[str], n: int = 4) -> DataFrame:
    """The first ``n`` games in stock in the given categories."""
    return in_stock(games, True).filter(F.col("category").isin(*categories)).orderBy("game_id").limit(n)


def search_games(games: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Games that hold every word of ``q``, or ``q`` as a substring; name hits first, then rating.

    A word is a run of letters and digits of any script. English stop words are not asked for; words match by their
    English stems, so "games" finds "game". The stems of ``q`` are found once, and only words that begin like one of them
    are stripped.
    """
    words = [w for w in re.findall(r"[^\W_]+", q.lower()) if w not in STOP_WORDS]
    text = F.lower(F.concat_ws(" ", "name", "description", F.array_join("tags", " ")))
    tokens = F.split(text, r"[^\p{L}\p{N}]+")
    if words:
        asked = F.transform(F.array(*[F.lit(w) for w in words]), stem)
        # One subquery, computed before the scan.
        games = games.withColumn("_wanted", games.sparkSession.range(1).select(asked.alias("wanted")).scalar())
        all_words = F.forall("_wanted", lambda w: F.exists(tokens, lambda token: same_stem(token, w)))
    else:
        all_words = F.lit(False)
    holds = lambda name: F.coalesce(F.col(name).ilike(f"%{q}%"), F.lit(False))
    hit = all_words | holds("name") | holds("description") | holds("category")
    name_first = F.when(holds("name"), 1).otherwise(2)
    found = games.filter(hit).drop("_wanted")
    return found.orderBy(name_first, F.desc_nulls_first("rating"), F.asc("game_id")).limit(limit)


def search_substring(
    games: DataFrame, q: str, category: str | None = None, min_price: Decimal | str | None = None,
    max_price: Decimal | str | None = None,
) -> DataFrame:
    """Games with ``q`` inside the name, the description or a tag, in a category and price range."""
    wanted = q.lower()
    hit = (
        F.lower("name").contains(wanted)
        | F.coalesce(F.lower("description").contains(wanted), F.lit(False))
        | F.coalesce(F.exists("tags", lambda tag: F.lower(tag).contains(wanted)), F.lit(False))
    )
    found = games.filter(hit)
    if category:
        found = found.filter(F.lower("category") == category.lower())
    return filter_games(found, min_price=min_price, max_price=max_price)


def featured(games: DataFrame, n: int = 4) -> DataFrame:
    """Featured games: best rating first, then newest."""
    return games.filter("is_featured").orderBy(
        F.desc_nulls_first("rating"), F.desc_nulls_first("created_at"), F.asc("game_id")
    ).limit(n)


def featured_by_stock(games: DataFrame, n: int = 4) -> DataFrame:
    """Games with the largest stock."""
    return in_stock(games, True).orderBy(F.desc("stock_quantity"), F.asc("game_id")).limit(n)


def catalogue_summary(games: DataFrame) -> DataFrame:
    """Catalogue headline in one row."""
    return games.agg(
        F.count("*").alias("total_games"),
        F.count_if("is_featured").alias("featured_games"),
        F.count_if("is_trending").alias("trending_games"),
        F.round(F.avg("price"), 2).alias("average_price"),
        F.count_distinct("category").alias("total_categories"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
    )


def catalogue_by_category(games: DataFrame) -> DataFrame:
    """Games, mean price and mean rating per category, largest first."""
    return games.groupBy("category").agg(
        F.count("*").alias("game_count"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        F.round(F.avg("rating"), 2).alias("avg_rating"),
    ).orderBy(F.desc("game_count"), "category")


def _ratings(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("game_id").agg(
        F.sum("rating").alias("_points"), F.count("rating").alias("_rated"), F.count("*").alias("_reviews")
    )


def _sales(items: DataFrame) -> DataFrame:
    return items.groupBy("game_id").agg(
        F.sum("quantity").alias("_units"), F.sum("total_price").alias("_revenue"), F.count("*").alias("_lines")
    )


def _average_rating() -> Column:
    return F.round(F.try_divide(F.col("_points"), F.col("_rated")), 2)


def game_ratings(games: DataFrame, reviews: DataFrame, verified_only: bool = False) -> DataFrame:
    """Average rating and review count per game; games without reviews are kept."""
    chosen = reviews.filter("is_verified_purchase") if verified_only else reviews
    return games.join(_ratings(chosen), "game_id", "left").select(
        *games.columns, _average_rating().alias("average_rating"), F.coalesce("_reviews", F.lit(0)).alias("review_count")
    )


def game_stats(games: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Per game the figures of joining reviews and order lines in one step.

    That join repeats each sale once per review and each review once per sale. The repeated sums
    are products of per-game totals, so each side is added up first and no pair is built.
    """
    review_copies = F.greatest(F.coalesce("_lines", F.lit(0)), F.lit(1))
    sale_copies = F.greatest(F.coalesce("_reviews", F.lit(0)), F.lit(1))
    joined = games.join(_ratings(reviews), "game_id", "left").join(_sales(items), "game_id", "left")
    return joined.select(
        "game_id", "name", "category", "price", "discount_price",
        _average_rating().alias("average_rating"),
        (F.coalesce("_reviews", F.lit(0)) * review_copies).alias("review_count"),
        (F.col("_units") * sale_copies).alias("total_sold"),
        (F.col("_revenue") * sale_copies).alias("total_revenue"),
    )


def game_stats_dedup(games: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Per game its rating, review count, units and revenue, each counted once."""
    joined = games.join(_ratings(reviews), "game_id", "left").join(_sales(items), "game_id", "left")
    return joined.select(
        "game_id", "name", "category", "price", "discount_price",
        _average_rating().alias("average_rating"),
        F.coalesce("_reviews", F.lit(0)).alias("review_count"),
        F.col("_units").alias("total_sold"),
        F.col("_revenue").alias("total_revenue"),
    )


def trending_games(games: DataFrame, stats: DataFrame, n: int = 6) -> DataFrame:
    """Trending games by units sold, unsold last, then by rating."""
    sold = stats.select("game_id", "total_sold")
    return (
        games.filter("is_trending").join(sold, "game_id", "left")
        .orderBy(F.desc_nulls_last("total_sold"), F.desc_nulls_first("rating"), F.asc("game_id")).limit(n)
        .withColumn("total_sold", F.coalesce("total_sold", F.lit(0)))
    )


def top_sellers(stats: DataFrame, n: int = 5) -> DataFrame:
    """Games by units sold, unsold last."""
    return stats.orderBy(F.desc_nulls_last("total_sold"), F.asc("game_id")).limit(n)


def category_performance(games: DataFrame, stats: DataFrame) -> DataFrame:
    """Games, mean price, units and revenue per category, best revenue first."""
    sold = stats.select("game_id", "total_sold", "total_revenue")
    return games.join(sold, "game_id", "left").groupBy("category").agg(
        F.count("*").alias("games_count"),
        F.try_divide(F.sum("price").cast("double"), F.count("price")).alias("average_price"),
        F.sum(F.coalesce("total_sold", F.lit(0))).alias("total_sold"),
        F.sum(F.coalesce("total_revenue", F.lit(0))).alias("total_revenue"),
    ).orderBy(F.desc_nulls_last("total_revenue"), "category")


def latest_reviews(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest reviews of each game with their position."""
    return newest_per_key(reviews, ["game_id"], "created_at", n, "review_id")


def reviews_with_author(reviews: DataFrame, customers: DataFrame) -> DataFrame:
    """Reviews with the author's name where the author is a known customer."""
    authors = customers.select(F.col("customer_id").alias("user_id"), "first_name", "last_name")
    return reviews.join(authors, "user_id", "left")


def game_documents(games: DataFrame, reviews: DataFrame, customers: DataFrame, n: int = 5) -> DataFrame:
    """Each game with its rating and an array of its ``n`` newest reviews, whole and with their authors."""
    newest = reviews_with_author(latest_reviews(reviews, n), customers)
    review = F.struct("position", *[c for c in newest.columns if c not in ("position", "game_id")])
    arrays = newest.groupBy("game_id").agg(F.sort_array(F.collect_list(review)).alias("reviews"))
    return game_ratings(games, reviews).join(arrays, "game_id", "left")
