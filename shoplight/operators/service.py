"""Service performance metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplight.functions.quantiles import exact_percentile
from shoplight.functions.times import trailing

AsOf = dt.datetime | Column | None
KEYS = ["service_name", "metric_type"]


def performance_metrics(samples: DataFrame, length: str = "1 HOUR", as_of: AsOf = None, exact: bool = False) -> DataFrame:
    """Mean, least, greatest, 95th percentile and sample count per service and metric.

    The percentile is a bounded, mergeable estimate in the same pass; ``exact`` interpolates the true
    one with a second pass over a narrow band of values.
    """
    recent = trailing(samples, "timestamp", length, as_of)
    measures = [
        F.avg("metric_value").alias("avg_value"),
        F.min("metric_value").alias("min_value"),
        F.max("metric_value").alias("max_value"),
        F.count("*").alias("sample_count"),
    ]
    if not exact:
        p95 = F.percentile_approx("metric_value", 0.95, 10000).alias("p95_value")
        stats = recent.groupBy(*KEYS).agg(*measures, p95)
    else:
        p95s = exact_percentile(recent, KEYS, "metric_value", 0.95).withColumnRenamed("percentile", "p95_value")
        stats = recent.groupBy(*KEYS).agg(*measures).join(p95s, KEYS, "left")
    return stats.orderBy(*KEYS)


def performance_by_service(stats: DataFrame) -> DataFrame:
    """Per service a map from metric to its figures; there is one input row per service and metric."""
    figures = F.struct(
        F.col("avg_value").alias("avg"), F.col("min_value").alias("min"), F.col("max_value").alias("max"),
        F.col("p95_value").alias("p95"), F.col("sample_count").alias("samples"),
    )
    return stats.groupBy("service_name").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_type", figures))).alias("metrics")
    )
