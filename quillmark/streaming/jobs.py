"""States of jobs as a stream: events of a job are folded into what decides its state, in whatever order they come."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quillmark.operators.records import states
from quillmark.sources import keyed

#: What is kept of a job: its last start, and its last event, with times in microseconds.
KEPT = "begun_at bigint, begun_seq bigint, at bigint, seq bigint, kind string, step string, message string"
#: The event that a job gets which has been silent for too long.
TIMED_OUT = "The analysis took too long"
ENDED = ("success", "failure")


def _row(key, begun, last) -> Row:
    names = [part.split()[0] for part in KEPT.split(", ")]
    return Row(job_id=key[0], **dict(zip(names, (*begun, *last), strict=True)))


class Jobs(StatefulProcessor):
    """Keeps, by job, the last start and the last event; a running job without events for ``patience`` of event time fails."""

    def __init__(self, patience: dt.timedelta | None):
        self.patience = None if patience is None else patience // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", KEPT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.job.get() if self.job.exists() else None
        begun, last = (kept[0:2], kept[2:7]) if kept is not None else ((None, None), (None,) * 5)
        for r in rows:
            if r.kind == "start" and (begun[0] is None or (r.micros, r.seq) > tuple(begun)):
                begun = (r.micros, r.seq)
            if last[0] is None or (r.micros, r.seq) > tuple(last[:2]):
                last = (r.micros, r.seq, r.kind, r.step, r.message)
        self.job.update((*begun, *last))
        if self.patience is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            if self._running(begun, last):
                self.handle.registerTimer((last[0] + self.patience) // 1000)
        yield _row(key, begun, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.job.get()
        begun, last = kept[0:2], kept[2:7]
        if self._running(begun, last):
            last = (last[0] + self.patience, last[1], "failure", last[3], TIMED_OUT)
            self.job.update((*begun, *last))
            yield _row(key, begun, last)

    @staticmethod
    def _running(begun, last) -> bool:
        return begun[0] is not None and tuple(last[:2]) >= tuple(begun) and last[2] not in ENDED

    def close(self) -> None:
        pass


def follow(log: DataFrame, path: str, checkpoint: str, patience: dt.timedelta | None = None, late: str = "1 hour") -> StreamingQuery:
    """Keeps the states of the jobs of a streaming ``log`` (job_id, at, seq, kind, step, message) as keyed rows in ``path``.

    Each micro-batch replaces the rows of the jobs that it changed, so one that is run again ends in the same rows. With
    ``patience``, events may come ``late`` by as much, and no more. The session's state store must be the RocksDB one.
    """
    log = log.select("job_id", "at", F.unix_micros("at").alias("micros"), F.col("seq").cast("bigint").alias("seq"), "kind", "step", "message").where("job_id is not null and at is not null")
    log = log.withWatermark("at", late) if patience is not None else log
    schema = StructType([log.schema["job_id"]])
    for f in StructType.fromDDL(KEPT):
        schema.add(f)
    mode = "eventTime" if patience is not None else "none"
    kept = log.groupBy("job_id").transformWithState(Jobs(patience), schema, "update", mode)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # or the state would be gone through again for each use
        # a timer's row comes after the batch's own
        last = batch.groupBy("job_id").agg(F.max_by(F.struct("*"), F.struct("at", "seq")).alias("x")).select("x.*")
        begun = F.when(F.col("begun_at").isNotNull(), F.struct(F.timestamp_micros("begun_at").alias("at"), F.col("begun_seq").alias("seq")))
        rows = states(last.withColumns({"begun": begun, "at": F.timestamp_micros("at")}))
        keyed.replace(rows, last, path, "job_id")
        batch.unpersist()

    return kept.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
