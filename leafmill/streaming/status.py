"""Jobs followed as a stream: each job's state by its messages, and an error where it stays silent too long."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Milliseconds after a job's start within which its first progress, result or error is awaited. Fixed value.
TIMEOUT = 120_000
_OUT = StructType([StructField("job", StringType()), StructField("status", StringType()), StructField("at", LongType()), StructField("detail", StringType())])


class _Jobs(StatefulProcessor):
    """State of a job: its status, and whether anything was heard of it since its start."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", StructType([StructField("status", StringType())]))

    def _status(self) -> str | None:
        return self.job.get()[0] if self.job.exists() else None

    def _disarm(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["at"], ("start", "progress", "error", "done").index(r["kind"]))):
            was = self._status()
            if was in ("success", "error", "unsupported"):
                continue  # what comes after the end changes nothing
            now = {"start": "working", "progress": "working", "done": "success", "error": "unsupported" if (r["detail"] or "").startswith("unsupported") else "error"}[r["kind"]]
            if r["kind"] == "start" and was is None:
                self.handle.registerTimer(r["at"] + self.timeout)
            elif r["kind"] != "start":
                self._disarm()
            if now != was:
                self.job.update((now,))
                yield Row(job=key[0], status=now, at=r["at"], detail=r["detail"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._status() == "working":
            self.job.update(("error",))
            yield Row(job=key[0], status="error", at=expiredTimerInfo.getExpiryTimeInMs(), detail="timed out")

    def close(self) -> None:
        pass


def job_status(messages: DataFrame, timeout: int = TIMEOUT, late: str = "10 seconds") -> DataFrame:
    """(job, status, at, detail): a row for each change of a job's status, from messages(job, kind, ts, detail).

    kind is start, progress, done or error. A job that starts and isn't heard of within timeout milliseconds of event
    time is an error, as soon as the watermark is past that; its first other message disarms this. Messages later than
    the watermark are dropped, those after a job's end are ignored, those of unknown kinds or a null job too. Needs the
    state store of RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    known = messages.where(F.col("job").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("start", "progress", "done", "error"))
    rows = known.select(F.col("job").cast("string").alias("job"), "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("detail").cast("string").alias("detail")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("job").transformWithState(statefulProcessor=_Jobs(timeout), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
