"""Live order status history on Spark's keyed state.

Spark keeps the last status of every order in its state store (RocksDB) beside the checkpoint, by pages of orders, and restores
it after a failure. Only the history of changes is written as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shoplight.streaming.tables import start, write_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "order_id bigint, previous_status string, new_status string, at_micros bigint"
# Order numbers of one page of the state.
PAGE_ORDERS = 256


class StatusChanges(StatefulProcessor):
    """Compares each order's snapshots with each other and the first of a batch with the order's last status so far.

    The state of a page holds the last status of at most ``PAGE_ORDERS`` orders, so it is read and written once a batch for all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_statuses", "orders array<bigint>, statuses array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        stored = self.last.get()
        last = dict(zip(*stored)) if stored is not None else {}
        touched = False
        # A page's rows of one batch come in any order; the source's limits bound a batch.
        snapshots = [(r.order_id, r.at_micros, r.seq, r.order_status) for r in rows]
        snapshots.sort(key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2] is not None, s[2] or 0))
        for order, at, _, current in snapshots:
            if order not in last:
                touched, last[order] = True, current
            elif current != last[order]:
                yield Row(order_id=order, previous_status=last[order], new_status=current, at_micros=at)
                touched, last[order] = True, current
        if touched:
            self.last.update((list(last), list(last.values())))

    def close(self) -> None:
        pass


def status_changes(snapshots: DataFrame) -> DataFrame:
    """The changes of a stream of snapshots (order_id, seq, order_status, updated_at). Rows without an order are of no order.

    The state is kept by pages of neighbouring order numbers, as a call to the store costs more than comparing an order.
    """
    order = F.col("order_id").cast("bigint")
    known = snapshots.filter(order.isNotNull()).select(
        order.alias("order_id"), F.expr(f"(cast(order_id AS bigint) - pmod(cast(order_id AS bigint), {PAGE_ORDERS}L)) div {PAGE_ORDERS}L").alias("page"), F.col("seq").cast("bigint").alias("seq"), "order_status",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at_micros"))
    changes = known.groupBy("page").transformWithState(StatusChanges(), CHANGE, "Append", "None")
    return changes.select(
        "order_id", "previous_status", "new_status", F.lit("Status updated").alias("status_reason"), F.lit("system").alias("changed_by"),
        F.timestamp_micros("at_micros").alias("created_at"))


def stream_status_history(snapshots: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Record status changes in ``path``/history as order snapshots arrive.

    Snapshots of one batch are ordered by ``updated_at`` and ``seq``; batches follow each other as they arrive. NULL counts as
    a status of its own. The first snapshot of an order is the insert, not a change.
    """
    conf = snapshots.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return start(status_changes(snapshots), lambda batch, n: write_batch(batch, f"{path}/history", n), checkpoint, every=every)
    finally:  # a running stream keeps the setting that it began with
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)
