"""Streams that take several batches give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import audit
from tracewell.session import work_path
from tracewell.streaming import lifecycle

T0 = datetime(2026, 1, 1)
SCHEMA = (
    "execution_id string, pipeline_name string, environment_name string, run_id string, attempt_number int, correlation_id string, "
    "trigger_type string, status string, changed_at timestamp, change_no int, error_message string"
)


def batch(spark, rows):
    full = [(e, "p", "TEST", "r", 1, "c", "M", s, T0 + timedelta(minutes=m), m, msg) for e, s, m, msg in rows]
    return spark.createDataFrame(full, SCHEMA)


FIRST = [("a", "RUNNING", 0, None), ("b", "RUNNING", 1, None), ("a", "FAILED", 5, "bad"), ("c", "RUNNING", 6, None)]
SECOND = [("b", "SUCCESS", 20, None), ("a", "RUNNING", 21, None), ("a", "RUNNING", 22, None)]
THIRD = [("d", "SUCCESS", 300, None)]


@pytest.fixture()
def fed(spark):
    path = work_path(spark, "fed")
    for rows in (FIRST, SECOND, THIRD):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_lifecycle_equals_batch(spark, fed):
    got = lifecycle.run_available(lifecycle.stream_lifecycle(fed), "events", 2)
    want = audit.lifecycle_events(batch(spark, FIRST + SECOND + THIRD))
    columns = ["execution_id", "event_type", "event_at", "message"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_only_unfinished_attempts_are_stale(spark, fed):
    got = lifecycle.run_available(lifecycle.stream_stale(fed), "stale", 2)
    assert {(r["execution_id"], r["started_at"]) for r in got.collect()} == {
        ("a", T0 + timedelta(minutes=21)), ("c", T0 + timedelta(minutes=6))
    }


def test_repeated_attempts_enter_once(spark, fed):
    taken = lifecycle.run_available(lifecycle.stream_dedupe(fed), "intake", 2)
    assert taken.count() == 1


def test_late_rows_stay_out_of_closed_windows(spark):
    path = work_path(spark, "late")
    # A watermark set by one batch closes windows in the next one and refuses late rows in the one after that.
    later = [[("w", "RUNNING", 310, None)], [("z", "RUNNING", 2, None)], [("y", "SUCCESS", 600, None)]]
    for rows in (FIRST, THIRD, *later):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    counts = lifecycle.run_available(lifecycle.stream_status_counts(stream, "10 minutes", "10 minutes"), "late", 2)
    first = counts.where(F.col("window_start") == F.lit(T0)).collect()
    assert {(r["status"], r["changes"]) for r in first} == {("RUNNING", 3), ("FAILED", 1)}
