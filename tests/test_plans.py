"""Plan shapes that the results do not show."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from shoplight.functions.times import trailing
from shoplight.operators.catalogue import latest_reviews
from shoplight.operators.orders import filter_orders, game_library
from shoplight.operators.retention import apply_retention
from shoplight.operators.traffic import export_page_views, realtime_metrics
from shoplight.plans.registry import REGISTRY
from shoplight.session import cluster_settings
from shoplight.sources.shop_views import ShopViews
from shoplight.sources.sinks import append_batches

ROOT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark):
    return ShopViews(spark, ROOT)


def test_literal_bounds_reach_the_scan(views):
    text = plan(trailing(views.page_views, "timestamp", "7 DAY", dt.datetime(2024, 1, 20)))
    assert "GreaterThanOrEqual(ts,2024-01-13T00:00)" in text


def test_date_partitions_are_pruned(spark, views, tmp_path):
    append_batches(views.page_views, f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    recent = trailing(table, "timestamp", "2 DAY", dt.datetime(2024, 1, 20, 12))
    assert "PartitionFilters: [isnotnull(event_date#" in plan(recent) and ">= 2024-01-18)" in plan(recent)
    whole = trailing(views.page_views, "timestamp", "2 DAY", dt.datetime(2024, 1, 20, 12))
    assert recent.count() == whole.count()
    kept = apply_retention(table, "page_views", dt.datetime(2025, 1, 20), "timestamp")
    assert ">= 2024-01-16)" in plan(kept)
    assert kept.count() == apply_retention(views.page_views, "page_views", dt.datetime(2025, 1, 20), "timestamp").count()


def scanned_rows(df) -> int:
    """Rows that left the file scans of a finished query."""
    df.collect()

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        return sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("as_of", [dt.datetime(2024, 1, 1, 12), None])
def test_time_bounds_skip_row_groups(spark, tmp_path, as_of):
    """One date, sorted by time: a late bound reads few rows, as a literal and as a subquery."""
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") / 10).cast("decimal(18,6)"))
    rows = spark.range(432_000).select("id", (start + seconds).alias("timestamp"))
    small_groups = {"parquet.block.size": "65536", "parquet.page.size": "8192"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in small_groups.items():
        hadoop.set(key, value)
    try:
        append_batches(rows, f"{tmp_path}/t", sort_by=["timestamp"])
    finally:
        for key in small_groups:
            hadoop.unset(key)
    recent = trailing(spark.read.parquet(f"{tmp_path}/t"), "timestamp", "1 HOUR", as_of)
    counted = recent.agg(F.count("*"), F.max("id"))
    assert scanned_rows(counted) < 150_000
    assert counted.first()[0] in (36_000, 36_001)


def test_sketched_distinct_counts_take_one_shuffle(views):
    text = plan(export_page_views(views.page_views, as_of=dt.datetime(2024, 1, 20), approx=True).drop("date"))
    assert text.count("hashpartitioning") == 1 and "Expand" not in text


def test_shuffle_partitions_grow_with_the_input():
    small, large = cluster_settings(100, 10**9), cluster_settings(5000, 10**14)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(large["spark.sql.shuffle.partitions"]) > 300_000


def test_joins_on_a_hot_key_are_split(spark, tmp_path):
    """An order with a third of the lines: the adaptive join cuts its partition."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    order = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997)
    spark.range(0, 60_000, 1, 8).select(order.alias("order_id"), (F.col("id") % 50).alias("game_id")).write.parquet(f"{tmp_path}/i")
    spark.range(997).select(
        F.col("id").alias("order_id"), (F.col("id") % 90).alias("customer_id"), F.timestamp_seconds("id").alias("created_at")
    ).write.parquet(f"{tmp_path}/o")
    items, heads = spark.read.parquet(f"{tmp_path}/i"), spark.read.parquet(f"{tmp_path}/o")
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = game_library(items, heads)
        split = found.collect()
        assert "skew=true" in plan(found)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sorted(split) == sorted(game_library(items, heads).collect())


def test_status_filter_reaches_the_scan_through_the_view(views):
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan(
        filter_orders(views.orders, "pending", 5).select("order_id"))
    assert "EqualTo(o_custkey,5)" in plan(filter_orders(views.orders, customer_id=5).select("order_id"))


def test_top_k_is_not_a_full_sort(views):
    assert "TakeOrderedAndProject" in plan(realtime_metrics(views.page_views, as_of=dt.datetime(2024, 1, 20)))


def test_newest_rows_are_trimmed_before_the_shuffle(views):
    assert plan(latest_reviews(views.game_reviews)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n.startswith(("agg_", "jn_", "win_", "flt_", "ord_", "txt_", "dq_", "ing_", "src_", "snk_"))))
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(entry_point.queries()[name](spark, ROOT))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
