"""Streaming jobs, each run to the end of its input and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplight.functions.times import bucket
from shoplight.plans.registry import query
from shoplight.plans.windows import sessions_sql
from shoplight.schemas import RAW_TABLES
from shoplight.session import stored, work_dir
from shoplight.sources.shop_views import ShopViews
from shoplight.streaming import intake, sessions, status, summaries
from shoplight.streaming.tables import folders, read_states, read_table


class StreamViews(ShopViews):
    """The logical event tables as streams over the event files."""

    def base(self, name: str) -> DataFrame:
        if name != "events":
            return super().base(name)
        files = self.spark.readStream.schema(RAW_TABLES[name]).option("pathGlobFilter", "events.parquet")
        stream = files.parquet(self.root)
        return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class ShuffledStreamViews(StreamViews):
    """The event tables as streams over six files, each with events of all times, one file per batch."""

    def __init__(self, v: ShopViews, root: str):
        super().__init__(v.spark, v.root)
        rows = v.base("events").withColumn("ts", F.col("ts").cast("timestamp"))
        self.files = f"{root}/events"
        part = F.pmod(F.xxhash64("event_id"), F.lit(6)).cast("int")
        rows.withColumn("part", part).repartition(6, "part").write.partitionBy("part").parquet(self.files)
        self.schema = rows.schema

    def base(self, name: str) -> DataFrame:
        if name != "events":
            return super().base(name)
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.files}/part=*")


@query("str_ingest", """
SELECT 'page_views' AS target, session_id, count(*) AS row_count FROM envelope_events WHERE event_type = 'page_view' GROUP BY 2
UNION ALL SELECT 'game_interactions', session_id, count(*) FROM envelope_events WHERE event_type = 'game_interaction' GROUP BY 2
UNION ALL SELECT 'search_events', session_id, count(*) FROM envelope_events WHERE event_type = 'search' GROUP BY 2
UNION ALL SELECT 'performance_metrics', '', count(*) FROM envelope_events WHERE event_type = 'performance' GROUP BY 2
UNION ALL SELECT 'quarantine', session_id, count(*) FROM envelope_events WHERE event_type = 'purchase' GROUP BY 2
UNION ALL SELECT 'rejected', '', count(*) FROM ev WHERE event_no % 500 = 0
UNION ALL SELECT 'receipt', '', count(*) FROM ev""")
def str_ingest(v: ShopViews) -> DataFrame:
    root = work_dir(v.spark, "intake")
    v.batch_envelopes.select("body").write.option("compression", "gzip").text(f"{root}/bodies")
    files = sum(name.startswith("part-") for name in folders(v.spark, f"{root}/bodies")[0])
    bodies = intake.read_bodies(v.spark, f"{root}/bodies", files_per_trigger=max(1, -(-files // 2)))  # two batches
    intake.stream_ingest(bodies, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    counted = None
    for target in ("page_views", "game_interactions", "search_events", "performance_metrics", "quarantine", "rejected", "receipts"):
        rows = read_table(v.spark, f"{root}/out/{target}")
        session = F.col("session_id") if "session_id" in rows.columns else F.lit("")
        amount = F.sum("total") if target == "receipts" else F.count("*")
        part = rows.groupBy(session.alias("session_id")).agg(amount.alias("row_count")).select(
            F.lit(target.replace("receipts", "receipt")).alias("target"), "session_id", "row_count"
        )
        counted = part if counted is None else counted.unionAll(part)
    return counted


@query("str_hourly", """
SELECT date_trunc('hour', timestamp) AS metric_hour, 'hourly_summary' AS metric_type, count(*) AS total_events,
       count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users, 0 AS total_revenue,
       avg(time_on_page_seconds) AS avg_time_on_page
FROM page_views GROUP BY 1""")
def str_hourly(v: ShopViews) -> DataFrame:
    root = work_dir(v.spark, "hourly")
    live = ShuffledStreamViews(v, root)
    summaries.stream_traffic(live.page_views, f"{root}/states", f"{root}/checkpoint", "hour").awaitTermination()
    hours = summaries.finish_traffic(read_states(v.spark, f"{root}/states"), "metric_hour")
    return hours.select(
        "metric_hour", F.lit("hourly_summary").alias("metric_type"), F.col("page_views").alias("total_events"),
        "unique_sessions", "unique_users", F.lit(0).alias("total_revenue"), "avg_time_on_page",
    )


@query("str_hourly_sales", """
SELECT date_trunc('hour', purchase_timestamp) AS hour, game_id, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       count(*) AS total_orders
FROM purchase_events WHERE status = 'completed' GROUP BY 1, 2""")
def str_hourly_sales(v: ShopViews) -> DataFrame:
    root = work_dir(v.spark, "sales")
    live = ShuffledStreamViews(v, root)
    summaries.stream_hourly_sales(live.purchase_events, f"{root}/sales", f"{root}/checkpoint").awaitTermination()
    return summaries.finish_sales(read_states(v.spark, f"{root}/sales"))


_DAU = """SELECT CAST(timestamp AS DATE) AS date, game_id, count(DISTINCT user_id) AS unique_users
FROM game_interactions WHERE event_type = 'view' GROUP BY 1, 2"""


@query("str_dau", f"SELECT *, true AS sketch_close FROM ({_DAU})")
def str_dau(v: ShopViews) -> DataFrame:
    """The sketches' estimate, held against the exact count."""
    root = work_dir(v.spark, "dau")
    live = ShuffledStreamViews(v, root)
    summaries.stream_dau(live.game_interactions, f"{root}/sketches", f"{root}/checkpoint").awaitTermination()
    estimate = summaries.finish_dau(v.spark, f"{root}/sketches").withColumnRenamed("unique_users", "_estimate")
    exact = summaries.dau_exact(v.game_interactions)
    close = F.abs(F.col("_estimate") - F.col("unique_users")) <= F.greatest(F.lit(1.0), F.col("unique_users") * 0.05)
    return exact.join(estimate, ["date", "game_id"], "full").withColumn("sketch_close", close).drop("_estimate")


@query("str_dau_exact", _DAU)
def str_dau_exact(v: ShopViews) -> DataFrame:
    return summaries.dau_exact(v.game_interactions)


@query("str_realtime", """
SELECT date_trunc('minute', timestamp) AS window_start, date_trunc('minute', timestamp) + INTERVAL 1 MINUTE AS window_end,
       count(*) AS page_views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT user_id) AS unique_users, avg(time_on_page_seconds) AS avg_time_on_page
FROM page_views GROUP BY 1, 2""")
def str_realtime(v: ShopViews) -> DataFrame:
    return _realtime(v, "1 minute", None)


@query("str_realtime_sliding", """
SELECT window_end - INTERVAL 60 MINUTE AS window_start, window_end, count(*) AS page_views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT user_id) AS unique_users, avg(time_on_page_seconds) AS avg_time_on_page
FROM (SELECT session_id, user_id, time_on_page_seconds, unnest(generate_series(date_trunc('minute', timestamp) + INTERVAL 1 MINUTE,
             date_trunc('minute', timestamp) + INTERVAL 60 MINUTE, INTERVAL 1 MINUTE)) AS window_end FROM page_views)
GROUP BY 1, 2""")
def str_realtime_sliding(v: ShopViews) -> DataFrame:
    return _realtime(v, "1 hour", "1 minute")


def _realtime(v: ShopViews, length: str, slide: str | None) -> DataFrame:
    root = work_dir(v.spark, "realtime")
    live = ShuffledStreamViews(v, root)
    summaries.stream_realtime(live.page_views, f"{root}/states", f"{root}/checkpoint").awaitTermination()
    return summaries.finish_windows(read_states(v.spark, f"{root}/states"), length, slide)


@query("str_sessions", sessions_sql("30 MINUTE", "some_anonymous"))
def str_sessions(v: ShopViews) -> DataFrame:
    root = work_dir(v.spark, "sessions")
    events = ShuffledStreamViews(v, root).some_anonymous.select("user_id", "session_id", "timestamp")
    sessions.stream_sessions(events, f"{root}/slots", f"{root}/checkpoint").awaitTermination()
    return sessions.finish_sessions(read_states(v.spark, f"{root}/slots"))


@query("str_closed_sessions", f"SELECT * EXCLUDE (session_number) FROM ({sessions_sql('30 MINUTE', 'some_anonymous')})")
def str_closed_sessions(v: ShopViews) -> DataFrame:
    """Sessions written once when they are closed, and those still open, over three batches in time order."""
    root = work_dir(v.spark, "closed")
    events = v.some_anonymous.select("user_id", "session_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    cut = stored(events.repartitionByRange(3, "timestamp").withColumn("part", F.spark_partition_id()), "ordered-events")
    for part in range(3):
        cut.filter(F.col("part") == part).drop("part").coalesce(2).write.mode("append").parquet(f"{root}/events")
        stream = v.spark.readStream.schema(events.schema).parquet(f"{root}/events")
        sessions.stream_arrivals(stream, f"{root}/sessions", f"{root}/arrivals").awaitTermination()
    sessions.close_sessions(v.spark, f"{root}/sessions", f"{root}/closing").awaitTermination()
    closed = read_table(v.spark, f"{root}/sessions/closed")
    return closed.unionByName(sessions.open_sessions(v.spark, f"{root}/sessions"))


@query("str_user_counts", """
SELECT count(*) AS total_users, count(*) FILTER (WHERE newest >= {as_of} - INTERVAL 1 DAY) AS active_users,
       count(*) FILTER (WHERE oldest >= {as_of} - INTERVAL 1 DAY) AS new_users,
       count(*) FILTER (WHERE newest >= {as_of} - INTERVAL 1 DAY AND oldest < {as_of} - INTERVAL 1 DAY) AS returning_users
FROM (SELECT user_id, min(timestamp) AS oldest, max(timestamp) AS newest FROM some_anonymous
      WHERE user_id IS NOT NULL GROUP BY user_id)""")
def str_user_counts(v: ShopViews) -> DataFrame:
    """New and returning users from a table of first events and the period's dates alone."""
    root = work_dir(v.spark, "first-seen")
    live = ShuffledStreamViews(v, root).some_anonymous.select("user_id", "timestamp")
    summaries.stream_first_seen(live, f"{root}/first", f"{root}/checkpoint").awaitTermination()
    dated = v.some_anonymous.select("user_id", "timestamp").withColumn("event_date", F.to_date("timestamp"))
    dated.repartition("event_date").write.partitionBy("event_date").parquet(f"{root}/dated")
    return summaries.user_counts(v.spark.read.parquet(f"{root}/dated"), read_states(v.spark, f"{root}/first"), "1 DAY", v.newest_event())


@query("str_performance", """
SELECT date_trunc('hour', timestamp) AS period_start, service_name, metric_type, round(avg(metric_value), 6) AS avg_value,
       min(metric_value) AS min_value, max(metric_value) AS max_value, count(metric_value) AS sample_count, true AS p95_close
FROM performance_metrics WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3""")
def str_performance(v: ShopViews) -> DataFrame:
    """Hourly percentiles from sketches of six batches, held against the ranks of the samples."""
    root = work_dir(v.spark, "performance")
    live = ShuffledStreamViews(v, root).performance_metrics
    summaries.stream_performance(live, f"{root}/states", f"{root}/checkpoint").awaitTermination()
    hours = summaries.finish_performance(read_states(v.spark, f"{root}/states"))
    keys = ["period_start", "service_name", "metric_type"]
    samples = v.performance_metrics.select(bucket("timestamp", "hour").alias("period_start"), "service_name", "metric_type", "metric_value")
    below = F.count_if(F.col("metric_value") < F.col("p95_value"))
    upto = F.count_if(F.col("metric_value") <= F.col("p95_value"))
    close = (below <= F.ceil(F.count("metric_value") * 0.97)) & (upto >= F.floor(F.count("metric_value") * 0.93))
    return samples.filter("metric_value IS NOT NULL").join(hours, keys).groupBy(*keys, "avg_value", "min_value", "max_value", "sample_count").agg(
        close.alias("p95_close")).withColumn("avg_value", F.round("avg_value", 6))


@query("str_status_history", """
SELECT order_id, before AS previous_status, order_status AS new_status, 'Status updated' AS status_reason,
       'system' AS changed_by, updated_at AS created_at
FROM (SELECT *, lag(order_status) OVER w AS before, row_number() OVER w AS no FROM status_snapshots
      WINDOW w AS (PARTITION BY order_id ORDER BY updated_at, seq))
WHERE no > 1 AND order_status IS DISTINCT FROM before""")
def str_status_history(v: ShopViews) -> DataFrame:
    root = work_dir(v.spark, "status")
    snapshots = v.status_snapshots.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    # Cut by time and arriving one after another, each as a batch, so that orders go on over the batches and meet their kept status.
    seen = stored(snapshots, "snapshots")
    cuts = seen.agg(F.percentile_approx("updated_at", [0.25, 0.5, 0.75])).scalar()
    behind = [F.coalesce(F.col("updated_at") > F.get(cuts, F.lit(i)), F.lit(False)).cast("int") for i in range(3)]
    dated = seen.withColumn("part", behind[0] + behind[1] + behind[2])
    for number in range(4):
        dated.filter(F.col("part") == number).drop("part").write.mode("append").parquet(f"{root}/snapshots")
        stream = v.spark.readStream.schema(snapshots.schema).parquet(f"{root}/snapshots")
        status.stream_status_history(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return read_table(v.spark, f"{root}/out/history")
