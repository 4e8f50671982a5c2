"""Retention: drop rows older than their table keeps them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.functions.times import moment, span
from shoplight.schemas import EVENT_TIMES, RETENTION
from shoplight.session import stored
from shoplight.streaming.tables import drop_folder, folders

# Days; more than any month lacks against the longest one.
SLACK_DAYS = 4


# The column, and so the folder, of the day that a table's rows age by.
DAY = "aged_date"


def _kept(table: str, as_of: dt.datetime, ts: str | None, at: Column | None = None) -> Column:
    """A row lives until its time plus the table's span; NULL where it has no time.

    Month arithmetic does not invert exactly, so files and partitions are pruned by a plain bound
    that is a few days wider, and this exact rule decides the rest.
    """
    length, column = RETENTION[table]
    return (F.col(ts or column) if at is None else at) + span(length) > moment(as_of)


def apply_retention(df: DataFrame, table: str, as_of: dt.datetime, ts: str | None = None) -> DataFrame:
    """Rows still kept at ``as_of``; a row without a time is kept. Expired date partitions are not read where rows age by event time."""
    length, column = RETENTION[table]
    name = ts or column
    bound = moment(as_of) - span(length) - F.make_dt_interval(F.lit(SLACK_DAYS))
    if name in EVENT_TIMES and "event_date" in df.columns:
        df = df.filter(F.col("event_date").isNull() | (F.col("event_date") >= F.to_date(bound)))
    return df.filter(F.col(name).isNull() | ((F.col(name) >= bound) & _kept(table, as_of, ts)))


def retention_report(df: DataFrame, table: str, as_of: dt.datetime, ts: str | None = None) -> DataFrame:
    """Rows kept, dropped and kept for want of a time, in one pass; the three add up to all rows."""
    kept = _kept(table, as_of, ts)
    return df.agg(
        F.count_if(kept).alias("kept_rows"), F.count_if(~kept).alias("dropped_rows"), F.count_if(kept.isNull()).alias("unknown_rows")
    ).select(F.lit(table).alias("table_name"), "*")


def write_dated(df: DataFrame, table: str, path: str, ts: str | None = None) -> None:
    """Append rows to a table in folders of the date that ``table`` ages by, for ``expire``. Rows without a time have a folder too."""
    name = ts or RETENTION[table][1]
    dated = df.withColumn(DAY, F.to_date(name))
    dated.hint("rebalance", F.col(DAY)).write.mode("append").partitionBy(DAY).parquet(path)


def expire(spark: SparkSession, path: str, table: str, as_of: dt.datetime, ts: str | None = None) -> tuple[int, int]:
    """Remove what ``table`` keeps no more at ``as_of`` from a table of ``write_dated``; folders removed and days read.

    A day whose last instant is expired goes as a folder, which listing finds. Only days that hold both kept
    and expired instants are read and written anew, one or a few at the end of a month. An expiry that is run again
    finds nothing left to do.
    """
    names, _, _ = folders(spark, path)
    days = sorted(n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=") and "__HIVE" not in n)
    if not days:
        return 0, 0
    column = ts or RETENTION[table][1]
    first = F.col("day").cast("timestamp")
    edges = spark.createDataFrame([(d,) for d in days], "day string").select(
        "day", _kept(table, as_of, None, first).alias("begins"),
        _kept(table, as_of, None, first + F.make_dt_interval(F.lit(1)) - F.make_dt_interval(secs=F.lit(0.000001))).alias("ends")).collect()
    gone = [r["day"] for r in edges if not r["ends"]]
    border = [r["day"] for r in edges if r["ends"] and not r["begins"]]
    for day in gone:
        drop_folder(spark, f"{path}/{DAY}={day}")
    if border:
        rows = spark.read.parquet(path).filter(F.col(DAY).isin([dt.date.fromisoformat(d) for d in border]))
        if rows.filter(~_kept(table, as_of, column)).isEmpty():
            return len(gone), len(border)
        kept = stored(rows.filter(_kept(table, as_of, column)), "border-days")
        empty = {r[DAY].isoformat() for r in kept.select(DAY).distinct().collect()}
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        for day in set(border) - empty:
            drop_folder(spark, f"{path}/{DAY}={day}")
    return len(gone), len(border)
