"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplight.operators.sequences import in_chunks


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Interpolated percentile ``q`` of ``value`` per group, as column ``percentile``; NULL values do not count.

    Equal values are counted together first. The counted values are cut into ranges of group and value, added
    up inside each range, and moved by the sum of the group's ranges before: every group takes this path, and no
    task orders more than its range, however the groups are spread.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    ranges = in_chunks(counted, [*keys, "_value"], "counted-values")
    by_key = Window.partitionBy(*keys)
    ahead = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    wholes = ranges.groupBy(*keys, "_chunk").agg(F.sum("_rows").alias("_whole")).select(
        *keys, "_chunk", F.coalesce(F.sum("_whole").over(ahead), F.lit(0)).alias("_ahead"),
        ((F.sum("_whole").over(by_key) - 1) * F.lit(q)).alias("_rank"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumn("_upto", F.sum("_rows").over(inside)).alias("r").join(
        wholes.alias("w"), [*(F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys), F.col("r._chunk") == F.col("w._chunk")]
    ).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_value", "_rows", "_rank", (F.col("_upto") + F.col("_ahead")).alias("_upto"))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_rows") <= rank), F.col("_value")))
    low_rank = F.floor("_rank")
    found = placed.groupBy(*keys, "_rank").agg(at(low_rank).alias("_low"), at(F.ceil("_rank")).alias("_high"))
    return found.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_rank") - low_rank)).alias("percentile"))
