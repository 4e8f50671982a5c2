"""Time spans, trailing ranges and time buckets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplight.schemas import EVENT_TIMES

_SPAN = re.compile(r"^([0-9]{1,6}) (MINUTE|HOUR|DAY|WEEK|MONTH|YEAR)$")


def parse_span(text: str) -> tuple[int, str]:
    """Split ``"7 DAY"`` into number and unit; anything else is refused."""
    match = _SPAN.match(text.strip().upper())
    if not match:
        raise ValueError(f"not a time span: {text!r}")
    return int(match.group(1)), match.group(2)


def span(text: str) -> Column:
    """A literal interval for a span written as ``"7 DAY"``."""
    n, unit = parse_span(text)
    if unit == "YEAR":
        return F.make_ym_interval(F.lit(n), F.lit(0))
    if unit == "MONTH":
        return F.make_ym_interval(F.lit(0), F.lit(n))
    days = {"DAY": n, "WEEK": 7 * n}.get(unit, 0)
    hours = n if unit == "HOUR" else 0
    minutes = n if unit == "MINUTE" else 0
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def moment(value: dt.datetime | Column) -> Column:
    """A literal for a point in time; a datetime without a zone is UTC, whatever zone the driver runs in."""
    if isinstance(value, Column):
        return value
    return F.lit(value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc))


def trailing(df: DataFrame, ts: str, length: str, as_of: dt.datetime | Column | None = None) -> DataFrame:
    """Rows with ``ts`` inside the last ``length`` before ``as_of``.

    A literal ``as_of`` folds into one bound that reaches the file scan. Without it the newest
    time in ``df`` is used: the bound is then a scalar subquery, computed first and pushed
    into the scan when the query runs. On a table partitioned by ``event_date`` the bound also
    prunes partitions.
    """
    return since(df, ts, start_of(df, ts, length, as_of))


def start_of(df: DataFrame, ts: str, length: str, as_of: dt.datetime | Column | None) -> Column:
    """The time ``length`` before ``as_of``, or before the newest time in ``df``."""
    if as_of is None:
        return df.agg(F.max(ts) - span(length)).scalar()
    return moment(as_of) - span(length)


def since(df: DataFrame, ts: str, bound: Column) -> DataFrame:
    """Rows with ``ts`` at or after ``bound``."""
    if ts in EVENT_TIMES and "event_date" in df.columns:
        df = df.filter(F.col("event_date") >= F.to_date(bound))
    return df.filter(F.col(ts) >= bound)


def bucket(ts: str | Column, unit: str) -> Column:
    """Start of the minute, hour, day or month that holds ``ts``, without a zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, cut from microseconds."""
    start_us, end_us = (F.unix_micros(c.cast("timestamp")) for c in (start, end))
    return F.floor((end_us - start_us) / F.lit(1000000))
