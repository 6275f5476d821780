"""Incremental indexing driven by a stream of changed paths, with a state for each path.

An event is a path and, if known, when it changed and a digest of what it holds now. The state of a path is the newest event, how many changes it has seen, and
the digest that the index last took. Events that are older than the newest, and those that repeat it, change nothing. A path is due when no
event has come for a while (``quiet``): a timer is set anew by every change, so a file that is saved ten times in a row is read once; and not at all
if it ends up as the index has it. State and timers are Spark's, kept in its state store and recovered from the checkpoint.

A micro-batch of due paths is one update of the index. The last batch that was applied is noted beside the checkpoint, and one that runs again is passed over;
if the note itself was lost, the update replaces the same files by the same rows: nothing doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.functions import text as X
from corpusloom.plans.index import Indexer
from corpusloom.session import durable, prepare
from corpusloom.sources.files import existing, write_file

DUE = "path string, version long"
_STATE = "at long, digest string, version long, taken string, pending boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """Rows (path, at, digest) to due paths; see the module."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", _STATE)

    def _get(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, None, 0, None, False)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, digest, version, taken, pending = self._get()
        changed = False
        # Of events of one moment the later row counts; rows without a moment are newer than all before.
        for r in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0)):
            late = r["at"] is not None and at is not None and r["at"] < at
            same = r["digest"] is not None and r["digest"] == digest and version > 0
            repeated = r["at"] is not None and r["at"] == at and r["digest"] == digest
            if not late:
                at = r["at"] if r["at"] is not None else at
            if late or same or repeated:
                continue
            digest, version, changed = r["digest"], version + 1, True
        if not changed:
            self.state.update((at, digest, version, taken, pending))
            return
        if self.quiet_ms <= 0:
            self.state.update((at, digest, version, digest, False))
            yield Row(path=key[0], version=version)
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        self.state.update((at, digest, version, taken, True))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, digest, version, taken, pending = self._get()
        if not pending:
            return
        self.state.update((at, digest, version, digest, False))
        if digest is None or digest != taken:
            yield Row(path=key[0], version=version)

    def close(self) -> None:
        pass


def due_paths(events: DataFrame, quiet: float = 0.0) -> DataFrame:
    """(path, version) of a stream (path and, if it has them, at: timestamp, digest: string): each path when it is due, with the number of its changes so far.

    Paths are normal ones; null paths are passed over.
    """
    spark = events.sparkSession
    prepare(spark)
    spark.conf.set(_STORE, _ROCKS)
    at = F.unix_micros(F.col("at").cast("timestamp")) if "at" in events.columns else F.lit(None).cast("long")
    digest = F.col("digest").cast("string") if "digest" in events.columns else F.lit(None).cast("string")
    rows = events.where("path is not null").select(X.normal_path(F.col("path")).alias("path"), at.alias("at"), digest.alias("digest"))
    # With timers a query has always another batch to run: what only takes in what is there must end, and has none.
    time_mode = "ProcessingTime" if quiet > 0 else "None"
    return rows.groupBy("path").transformWithState(statefulProcessor=Changes(int(quiet * 1000)), outputStructType=DUE, outputMode="Update", timeMode=time_mode)


class Applied:
    """The number of the last batch that the index took, noted in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/applied-batch"

    def last(self) -> int:
        if not existing(self.spark, [self.path]):
            return -1
        return int(self.spark.read.text(self.path, wholetext=True).first()[0] or -1)

    def note(self, batch: int) -> None:
        write_file(self.spark, self.path, str(batch))


def reindex_stream(paths: DataFrame, indexer: Indexer, checkpoint: str, quiet: float = 0.0, interval: str | None = None) -> StreamingQuery:
    """Update the index as ``paths`` (see ``due_paths``) become due: what is there now, or every ``interval`` if one is given.

    ``quiet``: seconds without a change that make a path due; timers need an ``interval`` to go off.
    """
    if quiet > 0 and interval is None:
        raise ValueError("a quiet time needs an interval")
    applied = Applied(indexer.spark, f"{checkpoint}-applied")

    def update(batch: DataFrame, number: int) -> None:
        # Every partition is read, once: that commits the states.
        due = durable(batch.select("path").distinct())
        if number > applied.last() and not due.isEmpty():
            indexer.update(due)
            applied.note(number)

    writer = due_paths(paths, quiet).writeStream.foreachBatch(update).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
