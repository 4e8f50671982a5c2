"""Purchase funnel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplight.functions.scalars import distinct_count, funnel_position, percent
from shoplight.functions.times import trailing

AsOf = dt.datetime | Column | None


def _steps(purchases: DataFrame, length: str, as_of: AsOf, approx: bool) -> DataFrame:
    return trailing(purchases, "purchase_timestamp", length, as_of).groupBy("funnel_step").agg(
        F.count("*").alias("step_count"),
        distinct_count("session_id", approx).alias("unique_sessions"),
        F.sum("total_amount").alias("revenue"),
    )


def conversion_funnel(purchases: DataFrame, length: str = "7 DAY", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Rows, sessions and revenue per funnel step, in funnel order."""
    return _steps(purchases, length, as_of, approx).orderBy(funnel_position(F.col("funnel_step")), "funnel_step")


def funnel_by_count(purchases: DataFrame, length: str = "7 DAY", as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Rows and sessions per funnel step, largest first."""
    return _steps(purchases, length, as_of, approx).drop("revenue").orderBy(F.desc("step_count"), "funnel_step")


def funnel_rates(funnel: DataFrame) -> DataFrame:
    """Conversion and drop-off against the step before; one row per step comes in."""
    in_order = Window.orderBy(funnel_position(F.col("funnel_step")), "funnel_step")
    before = F.lag("step_count").over(in_order)
    rated = funnel.withColumn("_first", F.row_number().over(in_order) == 1).withColumn(
        "conversion_rate", F.when(F.col("_first"), F.lit(100.0)).otherwise(percent(F.col("step_count"), before))
    )
    return rated.withColumn("drop_off_rate", F.round(F.lit(100.0) - F.col("conversion_rate"), 2)).drop("_first")


def funnel_revenue(funnel: DataFrame) -> DataFrame:
    """Revenue over all funnel steps."""
    return funnel.agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"))
