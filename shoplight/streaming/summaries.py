"""Running summaries of traffic, sales and active users.

Each batch stores a mergeable state: sums per hour and game, one row per bucket, session and user, or one
sketch per group. Reading merges the states of all batches, so a row that comes late, however late, simply
joins its old bucket, and there is no watermark behind which rows are lost. States are partitioned by event
date: a reader of some dates reads only theirs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplight.functions.times import bucket, parse_span, since, start_of
from shoplight.streaming.tables import read_states, start, write_batch


def traffic_states(page_views: DataFrame, unit: str) -> DataFrame:
    """Views and summed time per bucket, session and user: everything the finished figures need."""
    return page_views.groupBy(bucket("timestamp", unit).alias("bucket"), "session_id", "user_id").agg(
        F.count("*").alias("views"),
        F.sum("time_on_page_seconds").alias("seconds"),
        F.count("time_on_page_seconds").alias("timed"),
    )


def stream_traffic(
    page_views: DataFrame, path: str, checkpoint: str, unit: str = "hour", every: str | None = None
) -> StreamingQuery:
    """Keep traffic states per hour or minute up to date; a reader of some dates reads only their partitions."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        states = traffic_states(batch, unit).withColumn("event_date", F.to_date("bucket"))
        write_batch(states, path, batch_id, ["event_date"])

    return start(page_views, handle, checkpoint, every=every)


def merge_traffic(states: DataFrame) -> DataFrame:
    """Traffic states of several batches as one, for ``compact``."""
    return states.groupBy("bucket", "session_id", "user_id", "event_date").agg(
        F.sum("views").alias("views"), F.sum("seconds").alias("seconds"), F.sum("timed").alias("timed"))


def finish_traffic(states: DataFrame, name: str) -> DataFrame:
    """True views, distinct sessions, distinct users and mean time per bucket from merged states."""
    return states.groupBy(F.col("bucket").alias(name)).agg(
        F.sum("views").alias("page_views"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        F.try_divide(F.sum("seconds").cast("double"), F.sum("timed")).alias("avg_time_on_page"),
    )


def _minutes(length: str) -> int:
    n, unit = parse_span(length.removesuffix("s").removesuffix("S"))
    if unit not in ("MINUTE", "HOUR", "DAY"):
        raise ValueError("a window is some minutes, hours or days long")
    return n * {"MINUTE": 1, "HOUR": 60, "DAY": 1440}[unit]


def stream_realtime(page_views: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Live traffic: states per minute, which ``finish_windows`` rolls up to any window."""
    return stream_traffic(page_views, path, checkpoint, "minute", every)


def finish_windows(states: DataFrame, length: str = "1 minute", slide: str | None = None) -> DataFrame:
    """True traffic per tumbling or sliding window of whole minutes, from minute states.

    Windows begin at multiples of ``slide`` (by default ``length``) from midnight 1970. Sums are added up per minute and then
    per window. Windows that overlap count a session or user once: its minutes become runs of windows
    without a gap, each adds one where it begins and takes one off where it ends, and a running sum tells how many
    are there. So a state goes into two rows at most, however many windows it lies in.
    """
    long, step = _minutes(length), _minutes(slide or length)
    minute = F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / 60)
    first = ((F.floor((F.col("_minute") - long) / step) + 1) * step).cast("bigint")
    last = (F.floor(F.col("_minute") / step) * step).cast("bigint")
    timed = states.withColumn("_minute", minute.cast("bigint"))
    amounts = ["views", "seconds", "timed"]
    # One row per minute, and then one per window that holds any.
    per_minute = timed.groupBy("_minute").agg(*[F.sum(c).alias(c) for c in amounts])
    windows = (per_minute.withColumn("_begin", F.explode(F.sequence(first, last, F.lit(step).cast("bigint")))).groupBy("_begin")
               .agg(*[F.sum(c).alias(c) for c in amounts]))
    none = F.lit(0).cast("bigint")
    rows = windows.select("_begin", *amounts, none.alias("sessions"), none.alias("users"))
    for name, column in (("sessions", "session_id"), ("users", "user_id")):
        turns = _comings_and_goings(timed, column, first, last, step)
        blank = [F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in amounts]
        rows = rows.unionByName(turns.select("_begin", *blank, *[(F.col("turn") if n == name else none).alias(n) for n in ("sessions", "users")]))
    merged = rows.groupBy("_begin").agg(*[F.sum(c).alias(c) for c in (*amounts, "sessions", "users")]).withColumn("_day", F.floor(F.col("_begin") / 1440))
    # Running sums inside a day, moved by those of the days before: one row per day.
    ahead = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = merged.groupBy("_day").agg(F.sum("sessions").alias("s"), F.sum("users").alias("u")).select(
        "_day", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("s", "u")])
    inside = Window.partitionBy("_day").orderBy("_begin").rowsBetween(Window.unboundedPreceding, 0)
    counted = merged.withColumns({c: F.sum(c).over(inside) for c in ("sessions", "users")}).join(days, "_day").filter("views IS NOT NULL")
    begin = F.timestamp_seconds(F.col("_begin") * 60).cast("timestamp_ntz")
    return counted.select(
        begin.alias("window_start"), (begin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(long))).alias("window_end"),
        F.col("views").alias("page_views"), (F.col("sessions") + F.col("s_ahead")).alias("unique_sessions"),
        (F.col("users") + F.col("u_ahead")).alias("unique_users"),
        F.try_divide(F.col("seconds").cast("double"), F.col("timed")).alias("avg_time_on_page"))


def _comings_and_goings(timed: DataFrame, column: str, first: Column, last: Column, step: int) -> DataFrame:
    """(_begin, turn): 1 where a run of windows that hold a value begins, -1 at the first window after it.

    A value has one row per minute at most, so one that a third of the rows have is ordered by a task in the size of the time asked for.
    """
    minutes = timed.filter(F.col(column).isNotNull()).select(column, "_minute").distinct().select(
        column, first.alias("_first"), last.alias("_last")).filter("_first <= _last")
    by_value = Window.partitionBy(column).orderBy("_last", "_first")
    runs = minutes.withColumn("_opens", F.coalesce(F.col("_first") > F.lag("_last").over(by_value) + step, F.lit(True))).withColumn(
        "_closes", F.coalesce(F.lead("_first").over(by_value) > F.col("_last") + step, F.lit(True)))
    turns = F.filter(F.array(
        F.struct(F.col("_first").alias("_begin"), F.when(F.col("_opens"), 1).otherwise(0).cast("bigint").alias("turn")),
        F.struct((F.col("_last") + step).alias("_begin"), F.when(F.col("_closes"), -1).otherwise(0).cast("bigint").alias("turn")),
    ), lambda t: t["turn"] != 0)
    return runs.filter("_opens OR _closes").select(F.inline(turns)).groupBy("_begin").agg(F.sum("turn").alias("turn"))


def hourly_sales(purchases: DataFrame) -> DataFrame:
    """Revenue and orders per hour and game over completed purchases."""
    return (
        purchases.filter(F.col("status") == "completed").groupBy(bucket("purchase_timestamp", "hour").alias("hour"), "game_id")
        .agg(F.sum("total_amount").alias("total_revenue"), F.count("*").alias("total_orders"))
    )


def stream_hourly_sales(purchases: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hourly sales of each batch, as sums that add up over batches."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(hourly_sales(batch).withColumn("event_date", F.to_date("hour")), path, batch_id, ["event_date"])

    return start(purchases, handle, checkpoint, every=every)


def merge_sales(states: DataFrame) -> DataFrame:
    """Sums of several batches as one, for ``compact``."""
    kind = states.schema["total_revenue"].dataType
    return states.groupBy("hour", "game_id", "event_date").agg(
        F.sum("total_revenue").cast(kind).alias("total_revenue"), F.sum("total_orders").alias("total_orders"))


def finish_sales(states: DataFrame) -> DataFrame:
    """Revenue and orders per hour and game from merged sums."""
    return states.groupBy("hour", "game_id").agg(F.sum("total_revenue").alias("total_revenue"), F.sum("total_orders").alias("total_orders"))


def active_user_sketches(interactions: DataFrame) -> DataFrame:
    """One mergeable sketch of viewing users per day and game."""
    return interactions.filter(F.col("event_type") == "view").groupBy(
        F.to_date("timestamp").alias("event_date"), "game_id"
    ).agg(F.hll_sketch_agg("user_id").alias("users"))


def stream_dau(interactions: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Daily active users per game, as sketches."""
    return start(
        interactions, lambda df, batch_id: write_batch(active_user_sketches(df), path, batch_id, ["event_date"]), checkpoint,
        every=every,
    )


def merge_dau(sketches: DataFrame) -> DataFrame:
    """Sketches of several batches as one, for ``compact``."""
    return sketches.groupBy("event_date", "game_id").agg(F.hll_union_agg("users").alias("users"))


def finish_dau(spark: SparkSession, path: str) -> DataFrame:
    """Estimated daily active users from the merged sketches."""
    return read_states(spark, path).groupBy(F.col("event_date").alias("date"), "game_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users")
    )


def dau_exact(interactions: DataFrame) -> DataFrame:
    """Daily active users per game, counted."""
    return interactions.filter(F.col("event_type") == "view").groupBy(
        F.to_date("timestamp").alias("date"), "game_id"
    ).agg(F.count_distinct("user_id").alias("unique_users"))


def first_seen(events: DataFrame) -> DataFrame:
    """Each known user's first event of a batch, by its date."""
    return events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("timestamp").alias("first_event")).withColumn(
        "event_date", F.to_date("first_event"))


def stream_first_seen(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a table of users' first events: each batch adds its own, and the earliest of a user counts."""
    return start(events, lambda df, batch_id: write_batch(first_seen(df), path, batch_id, ["event_date"]), checkpoint, every=every)


def merge_first_seen(rows: DataFrame) -> DataFrame:
    """First events of several batches as one row per user and date, for ``compact``."""
    return rows.groupBy("user_id", "event_date").agg(F.min("first_event").alias("first_event"))


def user_counts(events: DataFrame, seen: DataFrame, period: str, as_of: dt.datetime) -> DataFrame:
    """``traffic.user_counts`` from a table of first events; of ``events``, only the dates of the period are read."""
    begin = start_of(events, "timestamp", period, as_of)
    active = since(events, "timestamp", begin).filter(F.col("user_id").isNotNull()).select("user_id").distinct().withColumn("active", F.lit(True))
    users = seen.groupBy("user_id").agg(F.min("first_event").alias("first_event")).join(active, "user_id", "left")
    new = F.col("first_event") >= begin
    return users.agg(
        F.count("*").alias("total_users"), F.count_if("active").alias("active_users"), F.count_if(new).alias("new_users"),
        F.count_if(F.col("active") & ~new).alias("returning_users"))


# Items of a quantile sketch: the rank of an estimate is off by less than 1 % then, for 99 of 100 estimates.
SKETCH_ITEMS = 400


def performance_states(samples: DataFrame) -> DataFrame:
    """Sums, bounds and a mergeable quantile sketch per minute, service and metric. Samples without a value count for none of them."""
    return samples.filter(F.col("metric_value").isNotNull()).groupBy(
        bucket("timestamp", "minute").alias("bucket"), "service_name", "metric_type").agg(
        F.count("*").alias("samples"), F.sum("metric_value").alias("total"), F.min("metric_value").alias("low"), F.max("metric_value").alias("high"),
        F.kll_sketch_agg_double("metric_value", SKETCH_ITEMS).alias("sketch")).withColumn("event_date", F.to_date("bucket"))


def stream_performance(samples: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep service performance per minute, so that any range is answered from states alone."""
    return start(samples, lambda df, batch_id: write_batch(performance_states(df), path, batch_id, ["event_date"]), checkpoint, every=every)


def merge_performance(states: DataFrame) -> DataFrame:
    """States of several batches as one, for ``compact``."""
    return states.groupBy("bucket", "service_name", "metric_type", "event_date").agg(*_performance_sums())


def _performance_sums() -> list[Column]:
    return [F.sum("samples").alias("samples"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.kll_merge_agg_double("sketch").alias("sketch")]


def finish_performance(states: DataFrame, unit: str | None = "hour", q: float = 0.95) -> DataFrame:
    """Mean, bounds, the estimated percentile and sample count per service and metric and hour, or other unit, or over all states."""
    keys = ["service_name", "metric_type"]
    by = [F.date_trunc(unit, "bucket").cast("timestamp_ntz").alias("period_start"), *keys] if unit else keys
    merged = states.groupBy(*by).agg(*_performance_sums())
    return merged.select(
        *(["period_start"] if unit else []), *keys, (F.col("total") / F.col("samples")).alias("avg_value"), F.col("low").alias("min_value"),
        F.col("high").alias("max_value"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("p95_value"), F.col("samples").alias("sample_count"))
