"""Writers: table appends, dated CSV exports and JSON rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shoplight.schemas import EVENT_TIMES


def append_batches(
    df: DataFrame, path: str, ts: str = "timestamp", rows_per_file: int = 1_000_000, sort_by: Sequence[str] = (),
) -> dict[str, int]:
    """Append ``df`` to a table partitioned by ``event_date``; report the rows written.

    The rows are counted while they are written. File size is set by ``rows_per_file``,
    since files of a thousand rows would swamp a large table. Rows are rebalanced by date, so
    that a date gets few files and a very busy date is still split over several tasks, and
    sorted inside each file, so that a range of the leading sort column skips row groups.
    """
    if ts not in EVENT_TIMES:
        raise ValueError(f"{ts!r} is no event time; event_date would mislead time filters")
    written = Observation("append")
    (
        df.observe(written, F.count(F.lit(1)).alias("rows"))
        .withColumn("event_date", F.to_date(ts))
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", *sort_by)
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("event_date")
        .parquet(path)
    )
    return {"rows": int(written.get["rows"])}


def export_csv(df: DataFrame, root: str, subject: str, run_date: dt.date) -> str:
    """Write ``df`` without a header to the dated folder of its subject; returns the folder.

    A rerun of the same day replaces that day. The files keep the partitioning of ``df``.
    """
    path = f"{root}/{subject}/{run_date:%Y-%m-%d}"
    df.write.mode("overwrite").option("header", "false").csv(path)
    return path


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column ``json``; NULL fields are kept as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
