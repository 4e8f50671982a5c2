"""Sorting, pages and newest-first lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.functions.times import moment

# The column, and so the folder, of a range of a stored order.
RANGE = "_range"


def sort_keys(by: str, direction: str, allowed: Sequence[str], default: str, tie_break: str) -> list[Column]:
    """Sort columns: ``by`` if it is allowed, else ``default``; descending only if asked.

    NULLs sort last ascending and first descending. ``tie_break`` makes the order total.
    """
    column = by if by in allowed else default
    first = F.desc_nulls_first(column) if direction.upper() == "DESC" else F.asc_nulls_last(column)
    return [first, F.asc(tie_break)]


def safe_sort(
    df: DataFrame, by: str, direction: str, allowed: Sequence[str], default: str, tie_break: str
) -> DataFrame:
    """Sort by a column from an allowed list."""
    return df.orderBy(*sort_keys(by, direction, allowed, default, tie_break))


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """Page ``page`` of ``limit`` rows with item and page totals on each row.

    The page is a distributed top-k; the total is one scalar. A far page has to rank every row
    before it: use ``page_after`` to walk deep.
    """
    total = df.agg(F.count("*")).scalar()
    pages = F.ceil(total / limit)
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.select(
        "*",
        F.lit(page).alias("current_page"),
        pages.alias("total_pages"),
        total.alias("total_items"),
        F.lit(limit).alias("items_per_page"),
        (F.lit(page) < pages).alias("has_next_page"),
        F.lit(page > 1).alias("has_previous_page"),
    )


def write_pages(df: DataFrame, order: Sequence[Column], path: str, ranges: int | None = None) -> None:
    """Write ``df`` in ranges of ``order``, which must be total, and a directory with the rows of each range.

    Any page is then read from the one or two ranges that hold it (``stored_page``), however far it is.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.partitionBy(RANGE).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy(RANGE).agg(F.count("*").alias("row_count")).coalesce(1).write.parquet(f"{path}/directory")


def stored_page(spark: SparkSession, path: str, order: Sequence[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """``paginate`` of a table that ``write_pages`` wrote; the totals come from its directory, one row per range."""
    directory = sorted((r[RANGE], r["row_count"]) for r in spark.read.parquet(f"{path}/directory").collect())
    total, first = sum(n for _, n in directory), (page - 1) * limit
    pages = -(-total // limit)
    held, ahead = [], 0
    skipped = 0
    for number, n in directory:
        if ahead + n <= first:
            skipped = ahead + n
        elif ahead < first + limit:
            held.append(number)
        ahead += n
    rows = spark.read.parquet(f"{path}/rows").filter(F.col(RANGE).isin(held)).drop(RANGE)
    return rows.orderBy(*order).offset(max(first - skipped, 0)).limit(limit).select(
        "*", F.lit(page).alias("current_page"), F.lit(pages).cast("bigint").alias("total_pages"), F.lit(total).cast("bigint").alias("total_items"),
        F.lit(limit).alias("items_per_page"), F.lit(page < pages).alias("has_next_page"), F.lit(page > 1).alias("has_previous_page"))


def paginate_offset(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 10) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` with the total and whether more follow or precede."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.select(
        "*",
        total.alias("total"),
        (F.lit(offset + limit) < total).alias("has_next"),
        F.lit(offset > 0).alias("has_prev"),
    )


def page_after(df: DataFrame, sort: str, tie_break: str, last: tuple | None, limit: int = 10) -> DataFrame:
    """The ``limit`` rows after the row ``last = (sort value, tie-break value)``, newest first.

    The cost is one filtered top-k whatever the depth, where an offset pays for all earlier pages.
    """
    if last is not None:
        value, tie = (moment(v) if isinstance(v, dt.datetime) else F.lit(v) for v in last)
        df = df.filter((F.col(sort) < value) | ((F.col(sort) == value) & (F.col(tie_break) > tie)))
    return df.orderBy(F.desc(sort), F.asc(tie_break)).limit(limit)


def recent(df: DataFrame, ts: str, tie_break: str, n: int = 5) -> DataFrame:
    """The ``n`` newest rows."""
    return df.orderBy(F.desc(ts), F.asc(tie_break)).limit(n)


def recent_days(daily: DataFrame, day: str, period: str = "week") -> DataFrame:
    """A daily series for a period: the newest seven days for a week, everything for a month."""
    newest_first = daily.orderBy(F.desc(day))
    return newest_first.limit(7) if period == "week" else newest_first
