"""Ordered sequences: neighbours, steps, sessions, visits and status changes.

A window over a key sorts all rows of that key in one task. One key may hold a large
share of all rows, even at one instant, so row-level sequences are range-partitioned by key and the
whole order first: a partition is one chunk of the order, however the keys are spread. Sessions are folded into
slots before they open a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplight.functions.times import parse_span, seconds_between
from shoplight.session import stored

# Parts that the rows of one key are dealt to before a join with one row per key.
SALTS = 32
# Rows of a key that one task may hold; and groups of keys that are counted together first.
GROUPED_ROWS, KEY_GROUPS = 10_000, 1 << 16


def long_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` with more than ``GROUPED_ROWS`` rows, or none if no value has as many.

    Groups of keys are counted first, which moves few rows; single keys are counted only in groups with enough rows.
    """
    keyed = df.filter(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).alias("_group"))
    many = F.count("*") > GROUPED_ROWS
    groups = stored(keyed.groupBy("_group").agg(many.alias("_many")).filter("_many").select("_group"), "long-groups")
    if groups.isEmpty():
        return None
    found = keyed.join(groups, "_group", "left_semi").groupBy(key).agg(many.alias("_many")).filter("_many").select(key)
    found = stored(found, "long-keys")
    return None if found.isEmpty() else found


def in_chunks(df: DataFrame, order: Sequence[str], label: str = "sequences") -> DataFrame:
    """``df`` cut into ranges of ``order`` of about equal size, the number of each in ``_chunk``.

    The table is written once, so that all uses see the same cuts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in order])
    return stored(ranged.withColumn("_chunk", F.spark_partition_id()), label)


def _has_key(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def neighbours_in_chunks(
    chunked: DataFrame, keys: Sequence[str], order: Sequence[str], previous: Sequence[str], following: Sequence[str], number: str,
) -> DataFrame:
    """``with_neighbours`` for a table of ``in_chunks``; keeps ``_chunk``."""
    keys, order = list(keys), list(order)
    keyed = chunked.filter(_has_key(keys))
    carried = sorted({*previous, *following})
    row = F.struct(*carried) if carried else F.struct(F.lit(1).alias("_none"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = keyed.select(
        *chunked.columns,
        F.row_number().over(inside).cast("bigint").alias("_no"),
        F.lag(row).over(inside).alias("_prev"),
        F.lead(row).over(inside).alias("_next"),
    )
    # One row per chunk of a key; only keys that lie in several chunks need it, at most two per chunk.
    position = F.struct(*order)
    whole, across = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        keyed.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_rows"), F.min_by(row, position).alias("_first"), F.max_by(row, position).alias("_last"))
        .withColumn("_chunks", F.count("*").over(whole))
        .select(
            *keys, "_chunk", "_chunks",
            F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.lag("_last").over(across).alias("_prev_edge"),
            F.lead("_first").over(across).alias("_next_edge"),
        )
        .filter("_chunks > 1").drop("_chunks")
    )
    joined = rows.join(edges, [*keys, "_chunk"], "left")
    prev_row = F.coalesce("_prev", "_prev_edge")
    next_row = F.coalesce("_next", "_next_edge")
    found = joined.select(
        *chunked.columns,
        (F.col("_no") + F.coalesce("_before", F.lit(0))).alias(number),
        *[prev_row[c].alias(f"prev_{c}") for c in previous],
        *[next_row[c].alias(f"next_{c}") for c in following],
    )
    none = lambda c: F.lit(None).cast(chunked.schema[c].dataType)
    alone = chunked.filter(~_has_key(keys)).select(
        *chunked.columns, F.lit(1).cast("bigint").alias(number),
        *[none(c).alias(f"prev_{c}") for c in previous], *[none(c).alias(f"next_{c}") for c in following],
    )
    return found.unionByName(alone)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    number: str = "step_number",
) -> DataFrame:
    """Number the rows of each key in ``order`` and add ``prev_*`` and ``next_*`` columns.

    ``order`` must be unique within a key. A row whose key is NULL belongs to no sequence: it has number 1 and
    no neighbours. Every table takes the same path: chunks of the whole order, one window per key and
    chunk, and one summary row for each chunk of a key that lies in several, which gives the chunk's offset
    and the rows just outside it. No task holds more than its chunk, whatever the keys.
    """
    chunked = in_chunks(df, [*keys, *order])
    return neighbours_in_chunks(chunked, keys, order, previous, following, number).drop("_chunk")


def behavior_flow(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Step number and seconds since the previous step within each session; an event without a session stands alone."""
    steps = with_neighbours(events, ["session_id"], [ts, "event_id"], previous=[ts])
    gap = F.coalesce(seconds_between(F.col(f"prev_{ts}"), F.col(ts)), F.lit(0))
    return steps.withColumn("time_since_previous_step_seconds", gap).drop(f"prev_{ts}")


def _gap_micros(gap: str) -> int:
    n, unit = parse_span(gap)
    if unit in ("MONTH", "YEAR"):
        raise ValueError("a session gap has a fixed length: minutes, hours, days or weeks")
    return n * {"MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800}[unit] * 1_000_000


def visitors(events: DataFrame, user: str = "user_id", session: str = "session_id") -> list[Column]:
    """The two columns that tell visitors apart: the user or, where that is NULL, the client's session."""
    client = F.col(session) if session in events.columns else F.lit(None).cast("string")
    return [F.col(user), F.when(F.col(user).isNull(), client).alias("anonymous_session")]


def session_slots(events: DataFrame, gap: str = "30 MINUTE", user: str = "user_id", ts: str = "timestamp") -> DataFrame:
    """Events folded into slots as long as the gap, per visitor: first and last time and number.

    Two events in one slot are never further apart than the gap, so a slot belongs to exactly one session.
    Slots of several batches add up: ``fold_slots`` takes their union.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(*visitors(events, user), F.floor(at / F.lit(_gap_micros(gap))).alias("slot")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events")
    )


def fold_slots(slots: DataFrame, gap: str = "30 MINUTE", user: str = "user_id") -> DataFrame:
    """Sessions from slots: a pause longer than ``gap`` starts a new one."""
    visitor = [user, "anonymous_session"]
    merged = slots.groupBy(*visitor, "slot").agg(
        F.min("first").alias("_first"), F.max("last").alias("_last"), F.sum("events").alias("_events"))
    by_visitor = Window.partitionBy(*visitor).orderBy("slot")
    pause = F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.lag("_last").over(by_visitor).cast("timestamp"))
    numbered = merged.withColumn("_starts", F.coalesce((pause > _gap_micros(gap)).cast("int"), F.lit(1))).withColumn(
        "session_number", F.sum("_starts").over(by_visitor.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(*visitor, "session_number")
        .agg(
            F.min("_first").alias("session_start_time"),
            F.max("_last").alias("session_end_time"),
            F.sum("_events").alias("page_views"),
        )
        .withColumn(
            "session_duration_seconds", seconds_between(F.col("session_start_time"), F.col("session_end_time"))
        )
    )


def sessionise(events: DataFrame, gap: str = "30 MINUTE", user: str = "user_id", ts: str = "timestamp") -> DataFrame:
    """Sessions of each visitor: a pause longer than ``gap`` starts a new one.

    A visitor is a user or, where there is none, the client's own session (``anonymous_session``). Events are
    first folded into slots as long as the gap, so a visitor, however busy, enters the window with at most one
    row per slot.
    """
    return fold_slots(session_slots(events, gap, user, ts), gap, user)


def enrich_visits(page_views: DataFrame) -> DataFrame:
    """Page visits: heartbeats of one page folded together, with previous page, exit flag and time on page.

    Time on page runs to the next visit; the last visit of a session keeps the time the client sent. The
    chunks of the page views serve both steps.
    """
    keys, by_time = ["session_id"], ["timestamp", "event_id"]
    seen = neighbours_in_chunks(in_chunks(page_views, [*keys, *by_time]), keys, by_time, ["page_url"], [], "_no")
    new_page = (F.col("_no") == 1) | ~F.col("page_url").eqNullSafe(F.col("prev_page_url"))
    starts = stored(seen.filter(new_page).drop("prev_page_url", "_no"), "visits")
    visits = neighbours_in_chunks(starts, keys, by_time, ["page_url"], ["timestamp"], "visit_number")
    seconds = seconds_between(F.col("timestamp"), F.col("next_timestamp"))
    return visits.select(
        "session_id", "user_id", "event_id", "visit_number", "page_url",
        F.col("prev_page_url").alias("previous_page"),
        "timestamp",
        F.col("next_timestamp").isNull().alias("exit_page"),
        F.coalesce(seconds, F.col("time_on_page_seconds")).alias("time_on_page_seconds"),
    )


def conversion_time(purchases: DataFrame) -> DataFrame:
    """Seconds from a session's first view to each of its purchases; NULL without a session.

    Each part of a session (``SALTS`` of them) has one row with its first view. The parts of a session share the
    smallest, and each purchase meets the row of its own part, so a very busy session is spread over all parts.
    """
    part = F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).alias("_part")
    viewed = F.when(F.col("funnel_step") == "view", F.col("purchase_timestamp"))
    parts = purchases.filter(F.col("session_id").isNotNull()).groupBy("session_id", part).agg(F.min(viewed).alias("_own"))
    first = parts.withColumn("first_view", F.min("_own").over(Window.partitionBy("session_id"))).select("session_id", "_part", "first_view")
    bought = purchases.filter(F.col("funnel_step") == "purchase").select("event_id", "session_id", "purchase_timestamp", part)
    waited = seconds_between(F.col("first_view"), F.col("purchase_timestamp"))
    return bought.join(first, ["session_id", "_part"], "left").select(
        "event_id", "session_id", "purchase_timestamp",
        F.when(F.col("first_view") <= F.col("purchase_timestamp"), waited).alias("conversion_time_seconds"),
    )


def status_history(snapshots: DataFrame, order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """One row per change of an order's status between consecutive snapshots.

    NULL counts as a status of its own. The first snapshot is the insert, not a change. Orders of very many snapshots
    are compared in chunks, all others where their rows are.
    """
    long = long_keys(snapshots, "order_id")
    known = snapshots.filter(F.col("order_id").isNotNull())
    short = known if long is None else known.join(long, "order_id", "left_anti")
    inside = Window.partitionBy("order_id").orderBy(*order)
    columns = [*snapshots.columns, "prev_order_status", "_no"]
    seen = short.withColumns({"prev_order_status": F.lag("order_status").over(inside), "_no": F.row_number().over(inside).cast("bigint")}).select(*columns)
    if long is not None:
        rest = with_neighbours(known.join(long, "order_id", "left_semi"), ["order_id"], order, previous=["order_status"], number="_no")
        seen = seen.unionByName(rest.select(*columns))
    changed = (F.col("_no") > 1) & ~F.col("order_status").eqNullSafe(F.col("prev_order_status"))
    return seen.filter(changed).select(
        "order_id",
        F.col("prev_order_status").alias("previous_status"),
        F.col("order_status").alias("new_status"),
        F.lit("Status updated").alias("status_reason"),
        F.lit("system").alias("changed_by"),
        F.col(order[0]).alias("created_at"),
    )


def latest_by_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; each map task keeps one row per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def newest_per_key(df: DataFrame, keys: Sequence[str], ts: str, n: int, tie_break: str) -> DataFrame:
    """The ``n`` newest rows of each key with their ``position``; trimmed to ``n`` before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts), F.asc(tie_break))
    return df.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= n)


def growth_rate(periods: DataFrame, period: str, value: str) -> DataFrame:
    """Change against the previous period in percent; the input has one row per period."""
    previous = F.lag(value).over(Window.orderBy(period))
    return periods.withColumn("previous_value", previous).withColumn(
        "growth_rate", F.round(F.try_divide(F.col(value) - F.col("previous_value"), F.col("previous_value")) * 100, 2)
    )
