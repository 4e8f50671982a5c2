"""Continuous event intake."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplight.operators import ingest
from shoplight.schemas import SORT_KEYS
from shoplight.session import stored
from shoplight.streaming.tables import first_note, folders, start, write_batch


def read_bodies(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Request bodies, one per line, from a folder that new files arrive in."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")


def route_batch(bodies: DataFrame, out: str, batch_id: int, received: dt.datetime) -> None:
    """Unpack one micro-batch of both body forms, write its four tables, the quarantine and the receipt.

    A body is a batch if it has events, else a single event if it has a type, else it is rejected. Each body is
    parsed once for all the tables; the parsed batch is a stored table, so a lost executor costs no body. The receipt
    is written when all the others are there: ``read_received`` shows whole batches only.
    """
    unpacked = stored(ingest.unpack(bodies.select("body")), "intake")
    events = ingest.typed(unpacked.filter("_form <> 'rejected'"))
    rejected = unpacked.filter("_form = 'rejected'")
    dated = lambda rows: rows.withColumn("event_date", F.to_date("timestamp"))
    writes = [
        (table, dated(router(events, received)), ["event_date"], SORT_KEYS[table]) for table, router in ingest.ROUTERS.items()
    ]
    writes += [("quarantine", ingest.route_unknown(events), [], []), ("rejected", rejected.select("body"), [], [])]
    # The writes do not depend on each other, so their jobs run side by side; the first failure fails the batch.
    write = inheritable_thread_target(bodies.sparkSession)(
        lambda name, rows, partition_by, sort_by: write_batch(rows, f"{out}/{name}", batch_id, partition_by, sort_by)
    )
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(write, *job) for job in writes]:
            done.result()
    write_batch(ingest.ingest_receipt(events), f"{out}/receipts", batch_id)


def read_received(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of the intake without batches that are still being written, or whose write failed half way.

    Batches follow each other, so all up to the newest receipt are whole.
    """
    names, files, to_path = folders(spark, f"{out}/receipts")
    whole = [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=") and files.exists(to_path(f"{out}/receipts/{n}/_SUCCESS"))]
    rows = spark.read.parquet(f"{out}/{table}")
    return rows.filter(F.col("batch_id") <= max(whole, default=-1)).drop("batch_id")


def stream_ingest(bodies: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Route a stream of request bodies to the event tables below ``out``.

    Events wait in the source until a batch is written, so none is lost while the job is down. A batch that is run again
    keeps the time of its first try, so its rows are the same.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)
        received = dt.datetime.fromisoformat(first_note(batch.sparkSession, f"{checkpoint}-received/{batch_id}", now.isoformat()))
        route_batch(batch, out, batch_id, received)

    return start(bodies, handle, checkpoint, every=every)
