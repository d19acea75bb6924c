"""What a stream's batches admit, store and leave out, counted in the plan and written by a listener."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

SCHEMA = "run_id string, batch long, admitted long, stored long, late long, duplicates long"
ADMITTED, STORED = "tidemark_admitted", "tidemark_stored"


def observed(stream: DataFrame, name: str) -> DataFrame:
    """The stream, with its rows counted batch by batch under ``name`` (``ADMITTED`` where it enters, ``STORED`` where it leaves)."""
    return stream.observe(name, F.count(F.lit(1)).alias("n"))


def counted(stream: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of the stream, counted before and after it."""
    return observed(step(observed(stream, ADMITTED)), STORED)


class BatchCounts(StreamingQueryListener):
    """Appends a row per batch of the streams that are ``counted`` to the Parquet folder ``path``.

    ``late`` are the rows that came after the watermark, ``duplicates`` those that an operator of
    deduplication knew already, both as the stateful operators report them.  A batch that is done again after
    a failure has a row per attempt; ``read`` takes the latest.  Other streams of the session
    are passed over.  What cannot be written is in ``failed``, and ``finished`` raises it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.failed: list[Exception] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end(self, run_id: object) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._end(event.runId)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        progress = event.progress
        seen = progress.observedMetrics
        if ADMITTED not in seen:
            return
        late = sum(x.numRowsDroppedByWatermark for x in progress.stateOperators)
        known = sum(int(x.customMetrics.get("numDroppedDuplicateRows", 0)) for x in progress.stateOperators)
        row = (str(progress.runId), progress.batchId, seen[ADMITTED]["n"], seen[STORED]["n"] if STORED in seen else None, late, known)
        try:
            self.spark.createDataFrame([row], SCHEMA).withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as error:  # noqa: BLE001  the listener's thread must not end
            self.failed.append(error)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        """An idle stream has no batch to count."""

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._end(event.runId).set()

    def finished(self, query: StreamingQuery, timeout_s: float = 120) -> None:
        """Wait for the stream's end and for its last counts, which come a little later."""
        query.awaitTermination()
        if not self._end(query.runId).wait(timeout_s):
            raise TimeoutError(f"no end of {query.runId} after {timeout_s} s")
        if self.failed:
            raise self.failed[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every batch, the latest attempt of each."""
    rows = spark.read.schema(f"{SCHEMA}, written timestamp").parquet(path)
    return rows.groupBy("batch").agg(F.max_by(F.struct("run_id", "admitted", "stored", "late", "duplicates"), "written").alias("r")).select("batch", "r.*")
