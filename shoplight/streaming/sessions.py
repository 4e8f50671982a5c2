"""Live sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplight.functions.times import parse_span, seconds_between, span
from shoplight.operators.sequences import fold_slots, session_slots, sessionise, visitors
from shoplight.session import stored
from shoplight.streaming.tables import first_note, folders, start, write_batch


def stream_sessions(
    events: DataFrame, path: str, checkpoint: str, gap: str = "30 MINUTE", every: str | None = None
) -> StreamingQuery:
    """Store each batch's slots of visitors, at most one row per visitor and ``gap``; ``finish_sessions`` folds them.

    No event is too late: its slot joins the others when the sessions are read, and may extend or connect sessions.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(session_slots(batch, gap).withColumn("event_date", F.to_date("first")), path, batch_id, ["event_date"])

    return start(events, handle, checkpoint, every=every)


def merge_slots(slots: DataFrame) -> DataFrame:
    """Slots of several batches as one, for ``compact``."""
    return slots.groupBy("user_id", "anonymous_session", "slot", "event_date").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))


def finish_sessions(slots: DataFrame, gap: str = "30 MINUTE") -> DataFrame:
    """All sessions so far, open ones included; ``gap`` is the one the slots were made with."""
    return fold_slots(slots.drop("event_date"), gap)


def stream_arrivals(events: DataFrame, path: str, checkpoint: str, delay: str = "1 HOUR", every: str | None = None) -> StreamingQuery:
    """Split events into those on time and late ones: later by more than ``delay`` than the newest event of the batches before.

    Both are tables below ``path``, so no event is lost and the late ones are reported. The newest time after each batch is noted.
    """
    delay_of(delay)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch, "arrivals")
        spark = rows.sparkSession
        before = first_note(spark, f"{path}/newest/{batch_id - 1}", "") if batch_id else ""
        known = F.lit(before).cast("timestamp") if before else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col("timestamp") < known - span(delay), F.lit(False))
        write_batch(rows.filter(late), f"{path}/late", batch_id)
        write_batch(rows.filter(~late), f"{path}/on_time", batch_id)
        newest = rows.agg(F.max("timestamp").cast("string")).head()[0] or ""
        first_note(spark, f"{path}/newest/{batch_id}", max(before, newest))

    return start(events, handle, checkpoint, every=every)


def delay_of(text: str) -> dt.timedelta:
    """A delay of fixed length."""
    n, unit = parse_span(text)
    if unit in ("MONTH", "YEAR"):
        raise ValueError("a delay has a fixed length: minutes, hours, days or weeks")
    return dt.timedelta(minutes=n * {"MINUTE": 1, "HOUR": 60, "DAY": 1440, "WEEK": 10080}[unit])


def close_sessions(spark: SparkSession, path: str, checkpoint: str, gap: str = "30 MINUTE", delay: str = "1 HOUR") -> StreamingQuery:
    """Write each session once when it is closed: no event of it can come on time any more.

    A run takes all batches of ``stream_arrivals`` that are whole, and ends. Spark keeps the open sessions in its state
    store and drops nothing: what could be too late for it was told apart before.
    """
    on_time = spark.read.parquet(f"{path}/on_time").drop("batch_id")
    events = spark.readStream.schema(on_time.schema).parquet(f"{path}/on_time/batch_id=*").withWatermark("timestamp", delay)
    # A pause of just the gap stays inside a session.
    sessions = events.groupBy(*visitors(events), F.session_window("timestamp", f"{gap} 1 MICROSECOND").alias("_window")).agg(
        F.min("timestamp").alias("session_start_time"), F.max("timestamp").alias("session_end_time"), F.count("*").alias("page_views"))
    closed = sessions.drop("_window").withColumn(
        "session_duration_seconds", seconds_between(F.col("session_start_time"), F.col("session_end_time")))
    return start(closed, lambda batch, n: write_batch(batch, f"{path}/closed", n), checkpoint)


def open_sessions(spark: SparkSession, path: str, gap: str = "30 MINUTE") -> DataFrame:
    """The sessions of events on time that are not written as closed yet.

    A visitor's sessions are closed in order, so the open ones begin after the newest closed one.
    """
    events = spark.read.parquet(f"{path}/on_time").drop("batch_id")
    every = sessionise(events, gap)
    names, _, _ = folders(spark, f"{path}/closed")
    if not any(n.startswith("batch_id=") for n in names):
        return every.drop("session_number")
    keys = ["user_id", "anonymous_session"]
    newest = spark.read.parquet(f"{path}/closed").groupBy(*keys).agg(F.max("session_end_time").alias("_closed"))
    same = [every[k].eqNullSafe(newest[k]) for k in keys]
    return every.join(newest, same[0] & same[1], "left").filter("_closed IS NULL OR session_start_time > _closed").select(
        *[every[c] for c in every.columns if c != "session_number"])
