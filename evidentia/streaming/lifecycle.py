"""The life of a document as a state machine over its events, with a timer for those that get stuck.

Events are ``doc_id, sequence, at, event``. A document is ``pending`` once it is uploaded, ``indexing`` once a worker has
started on it, then ``indexed`` or ``failed``; it can be deleted whenever it is not being indexed, and what a worker still says
of a deleted document is ignored. One that stays ``pending`` or ``indexing`` beyond a time limit has failed: its timer
fires when the watermark passes the deadline, or the next event finds the deadline passed, whichever is seen first, so the
result does not depend on how events are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.functions.ship import ship

STUCK_AFTER = timedelta(hours=12)
LATENESS = "1 hour"
STUCK = "no progress within the time limit"
BUSY = "document is being indexed"

#: Status and event to the next status. What is not listed changes nothing.
STEPS = {
    ("absent", "uploaded"): "pending",
    ("pending", "started"): "indexing",
    ("indexing", "completed"): "indexed",
    ("indexing", "errored"): "failed",
    ("pending", "deleted"): "absent",
    ("indexed", "deleted"): "absent",
    ("failed", "deleted"): "absent",
}
TIMED = ("pending", "indexing")
CHANGES = "doc_id {key}, micros long, event string, status string, error string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """Keeps status and since when of each document that is there; a deleted one leaves no state."""

    def __init__(self, limit: timedelta = STUCK_AFTER):
        self.limit = limit // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", "status string, since long")

    def _read(self) -> tuple[str, int]:
        return tuple(self.state.get()) if self.state.exists() else ("absent", 0)

    def _keep(self, status: str, since: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "absent":
            self.state.clear()
            return
        self.state.update((status, since))
        if status in TIMED:
            self.handle.registerTimer(-(-(since + self.limit) // 1000))

    def _row(self, key: Any, at: int, event: str, status: str, error: str | None = None) -> Row:
        return Row(doc_id=key[0], micros=at, event=event, status="deleted" if status == "absent" else status, error=error)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, since = self._read()
        # The events of one document in one batch.
        for at, _, event in sorted((r.micros, r.sequence, r.event) for r in rows):
            if status in TIMED and since + self.limit < at:
                status, since = "failed", since + self.limit
                yield self._row(key, since, "timer", status, STUCK)
            following = STEPS.get((status, event), status)
            if following != status:
                status, since = following, at
                yield self._row(key, at, event, status)
            elif (status, event) == ("indexing", "deleted"):
                yield self._row(key, at, event, "refused", BUSY)
        self._keep(status, since)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, since = self._read()
        if status in TIMED and since + self.limit <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.update(("failed", since + self.limit))
            yield self._row(key, since + self.limit, "timer", "failed", STUCK)


def lifecycle(events: DataFrame, limit: timedelta = STUCK_AFTER, lateness: str = LATENESS) -> DataFrame:
    """Every change of status in a stream of events; requests to delete a document that is being indexed are ``refused``.

    The query that runs it needs ``rocksdb_state`` when it starts.
    """
    ship(events.sparkSession)
    timed = events.select("doc_id", "sequence", F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", lateness)
    timed = timed.withColumn("micros", F.unix_micros("at"))
    schema = CHANGES.format(key=events.schema["doc_id"].dataType.simpleString())
    changes = timed.groupBy("doc_id").transformWithState(Lifecycle(limit), schema, "append", "EventTime")
    return changes.select("doc_id", F.timestamp_micros("micros").alias("at"), "event", "status", "error")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State stores with timers; the setting is read when a query starts and put back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def current_status(changes: DataFrame) -> DataFrame:
    """Newest status of each document from its stored changes; a refused request is none."""
    return changes.where("status <> 'refused'").groupBy("doc_id").agg(
        F.max_by(F.struct("status", "error", "at"), "at").alias("s")).select("doc_id", "s.*")
