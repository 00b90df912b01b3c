"""Streams of status changes: lifecycle events, stale attempts, windowed counts and keyed intake.

State is kept per attempt in the state store, so it is spread over as many tasks as there are state partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.audit import (
    ATTEMPT_KEY, DONE_MESSAGE, EVENT_OF_STATUS, FAILED_MESSAGE, STALE_SECONDS, STARTED_MESSAGE,
)
from tracewell.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame]) -> Iterator:
    """One attempt's changes of one micro-batch in order; the source's trigger options bound their number."""
    return pd.concat(list(rows)).sort_values(["changed_at", "change_no"]).itertuples(index=False)


class _Lifecycle(StatefulProcessor):
    """Remembers the last status of an attempt and emits an event for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        out = []
        for r in _ordered(rows):
            if not known:
                out.append((key[0], "STARTED", r.changed_at, STARTED_MESSAGE))
            elif r.status != last:
                given = isinstance(r.error_message, str) and r.error_message
                text = (given or FAILED_MESSAGE) if r.status == "FAILED" else DONE_MESSAGE
                out.append((key[0], EVENT_OF_STATUS.get(r.status, r.status), r.changed_at, text))
            known, last = True, r.status
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["execution_id", "event_type", "event_at", "message"])

    def close(self) -> None:
        pass


class _Stale(StatefulProcessor):
    """Sets an event-time timer when an attempt starts running and drops it when the attempt ends."""

    def __init__(self, after_seconds: int) -> None:
        self.after = after_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started = self.started.get()[0] if self.started.exists() else None
        before = started
        for r in _ordered(rows):
            if r.status != "RUNNING":
                started = None
            elif started is None:
                started = int(r.changed_at.value // 1000)
        if started != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.after)
            if started is None:
                self.started.clear()
            else:
                self.started.update((started,))
                self.handle.registerTimer(started // 1000 + self.after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.started.exists():
            at = pd.Timestamp(self.started.get()[0], unit="us")
            yield pd.DataFrame({"execution_id": [key[0]], "started_at": [at]})

    def close(self) -> None:
        pass


def _in_order(changes: DataFrame, delay: str) -> DataFrame:
    columns = ["execution_id", "status", "changed_at", "change_no", "error_message"]
    return changes.select(*columns).withWatermark("changed_at", delay)


def stream_lifecycle(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Lifecycle events as the changes arrive; changes of one attempt must arrive in order."""
    return _in_order(changes, delay).groupBy("execution_id").transformWithStateInPandas(
        _Lifecycle(), "execution_id string, event_type string, event_at timestamp, message string", "append", "None"
    )


def stream_stale(changes: DataFrame, delay: str = "10 minutes", after_seconds: int = STALE_SECONDS) -> DataFrame:
    """Attempts still running when event time has passed the limit."""
    return _in_order(changes, delay).groupBy("execution_id").transformWithStateInPandas(
        _Stale(after_seconds), "execution_id string, started_at timestamp", "append", "EventTime"
    )


def stream_status_counts(changes: DataFrame, window: str, delay: str) -> DataFrame:
    """Changes per tumbling window and status; a window is final once the watermark has passed its end."""
    return (
        changes.withWatermark("changed_at", delay)
        .groupBy(F.window("changed_at", window), "status")
        .agg(F.count(F.lit(1)).alias("changes"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "status", "changes")
    )


def stream_dedupe(attempts: DataFrame) -> DataFrame:
    """Take each (pipeline, environment, run, attempt) once, however late it arrives.

    The state store keeps every key, as a unique index would. A watermark would free keys, but it would also drop
    late attempts that were never seen and store a late repeat again.
    """
    return attempts.dropDuplicates(ATTEMPT_KEY)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(
    stream: DataFrame, name: str, state_partitions: int | None = None, arrivals: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    """Process everything that has arrived, append it to files in the shared folder, and read them back.

    The file sink and the checkpoint make each batch count once, also after a restart. Each of ``arrivals`` brings
    more input once the input before it is done; the stream then goes on from its checkpoint.
    """
    spark = stream.sparkSession
    path, state = work_path(spark, name), work_path(spark, f"{name}-state")
    values = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions:
        values["spark.sql.shuffle.partitions"] = str(state_partitions)
    with _settings(spark, values):
        writer = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
        )
        writer.start().awaitTermination()
        for arrive in arrivals:
            arrive()
            writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
