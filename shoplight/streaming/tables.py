"""Stream output tables.

Every micro-batch owns one folder, ``batch_id=N``. A batch that is run again after a failure
replaces its folder, so each batch counts once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(
    df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> None:
    """Write one micro-batch's rows of a table, in few files per partition value.

    Rows are rebalanced by partition value first; a value with very many rows is split over
    several tasks, and values with few rows share one. Files are sorted by ``sort_by``.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by]).sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start ``handle`` on the micro-batches of ``stream``: all that is there now, or ``every`` interval."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a stream table."""
    return spark.read.parquet(path).drop("batch_id")


def folders(spark: SparkSession, path: str) -> tuple[list[str], object, object]:
    """Names below ``path``, its file system, and the class of paths."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    root = to_path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return found, files, to_path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that no reader uses any more."""
    _, files, to_path = folders(spark, path)
    files.delete(to_path(path), True)


def first_note(spark: SparkSession, path: str, text: str) -> str:
    """``text``, kept in a small file, or what the file holds since an earlier call."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    file = to_path(path)
    files = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(file) and files.getFileStatus(file).getLen() > 0:
        stream = files.open(file)
        try:
            return stream.readUTF()
        finally:
            stream.close()
    stream = files.create(file, True)
    try:
        stream.writeUTF(text)
    finally:
        stream.close()
    return text


def _merged(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """The newest finished compaction: its last batch, its date and its folder."""
    names, files, to_path = folders(spark, f"{path}-merged")
    done = sorted(n for n in names if files.exists(to_path(f"{path}-merged/{n}/_SUCCESS")))
    if not done:
        return None
    _, batch, _, before = done[-1].split("_")
    return int(batch), before, f"{path}-merged/{done[-1]}"


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table of mergeable states: the last compaction, and what came after it.

    Rows of a closed date that arrived after the compaction are in later batches, so none is lost or counted
    twice. Rows without a date are never closed. Filter on ``event_date`` to read the files of some dates only.
    """
    live = spark.read.parquet(path)
    merged = _merged(spark, path)
    if merged is None:
        return live.drop("batch_id")
    batch, before, folder = merged
    closed = F.coalesce(F.col("event_date") < F.to_date(F.lit(before)), F.lit(False))
    newer = live.filter((F.col("batch_id") > batch) | ~closed)
    return newer.drop("batch_id").unionByName(spark.read.parquet(folder))


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], before: dt.date) -> None:
    """Merge all states of dates before ``before`` into one folder, and remove what it replaces.

    A compaction counts once its success marker is there, so one that fails changes nothing. It is named by the
    last batch it holds; a reader skips the older batches' rows of these dates, whether removed yet or not.
    A date that is closed stays so: an earlier ``before`` than that of the last compaction is refused.
    """
    names, _, _ = folders(spark, path)
    batches = sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))
    if not batches:
        return
    old = _merged(spark, path)
    if old and before.isoformat() < old[1]:
        raise ValueError(f"states before {old[1]} are merged already, so {before} is too early")
    folder = f"{path}-merged/batch_{batches[-1]:012d}_before_{before:%Y-%m-%d}"
    if old and old[2] == folder:
        return
    closed = merge(read_states(spark, path).filter(F.col("event_date") < F.lit(before)))
    closed.hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(folder)
    if old:
        drop_folder(spark, old[2])
    for batch in batches:
        dates, _, _ = folders(spark, f"{path}/batch_id={batch}")
        days = [d for d in dates if d.startswith("event_date=")]
        gone = [d for d in days if d.removeprefix("event_date=") < before.isoformat()]
        if len(gone) == len(days) and batch != batches[-1]:
            drop_folder(spark, f"{path}/batch_id={batch}")
        else:
            for day in gone:
                drop_folder(spark, f"{path}/batch_id={batch}/{day}")
