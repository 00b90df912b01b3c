"""Retry history, observability rows and the exact rules of the log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import audit, observability as obs

NOW = datetime(2026, 1, 1, 12, 0, 0)
LOG = (
    "execution_id string, pipeline_name string, environment_name string, run_id string, attempt_number int, status string, "
    "started_at timestamp, finished_at timestamp, records_read long, records_written long, error_message string, "
    "correlation_id string, trigger_type string"
)


def attempt(run, status, start, finish, written=0, number=1, pipeline="p", message=None):
    at = [None if m is None else NOW - timedelta(minutes=m) for m in (start, finish)]
    return (f"{pipeline}-{run}-{number}", pipeline, "TEST", run, number, status, *at, written, written, message, f"{pipeline}:{run}", "MANUAL")


@pytest.fixture()
def observed(spark):
    rows = [
        attempt("success-1", "SUCCESS", 12, 11, 3),
        attempt("failed-1", "FAILED", 10, 9),
        attempt("success-2", "SUCCESS", 8, 7, 3, number=2),
        attempt("stale-1", "RUNNING", 45, None),
    ]
    return spark.createDataFrame(rows, LOG)


def now():
    return F.lit(NOW)


def test_runtime_metrics(observed):
    row = obs.runtime_metrics(observed, now()).first()
    assert (row["retry_count"], row["failure_count"], row["records_written"], row["stale_running"]) == (1, 1, 6, 1)
    assert (row["average_duration_seconds"], row["p95_duration_seconds"]) == (60, 60)
    assert row["last_success_timestamp_seconds"] == observed.select(F.unix_timestamp(F.lit(NOW - timedelta(minutes=7)))).first()[0]


def test_slo_and_alerts(observed):
    row = obs.slo(obs.status_totals(observed)).first()
    assert round(row["success_ratio"], 6) == 0.666667 and round(row["error_ratio"], 6) == 0.333333 and row["budget_remaining"] == 0
    found = {r["alertname"]: r["state"] for r in obs.alerts(observed, now()).collect()}
    assert found == {"ETLPipelineSLOBreach": "firing", "ETLStaleRunningExecution": "firing"}


def test_only_failures_have_no_ratio(spark):
    log = spark.createDataFrame([attempt("r", "FAILED", 10, 9)], LOG)
    totals = obs.status_totals(log)
    assert obs.slo(totals).count() == 0
    assert obs.slo(totals, zero_fill=True).first()["success_ratio"] == 0
    assert obs.alerts(log, now()).count() == 0
    assert obs.runtime_metrics(log, now()).first()["last_success_timestamp_seconds"] == 0


def test_thirty_minutes_is_not_stale(spark):
    log = spark.createDataFrame([attempt("a", "RUNNING", 30, None), attempt("b", "RUNNING", 31, None)], LOG)
    assert [r["run_id"] for r in audit.stale_running(log, now()).collect()] == ["b"]


def test_no_recent_success_waits(spark):
    def state(minutes):
        log = spark.createDataFrame([attempt("r", "SUCCESS", minutes + 1, minutes)], LOG)
        return [r["state"] for r in obs.alerts(log, now()).collect()]

    assert state(59) == [] and state(62) == ["pending"] and state(70) == ["firing"]


def changes(spark, rows):
    schema = (
        "execution_id string, pipeline_name string, environment_name string, run_id string, attempt_number int, "
        "correlation_id string, trigger_type string, status string, changed_at timestamp, change_no int, error_message string"
    )
    full = [(e, "p", "TEST", "r", 1, "p:r", "MANUAL", s, NOW + timedelta(seconds=i), i, m) for i, (e, s, m) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_lifecycle_events(spark):
    rows = [("a", "RUNNING", None), ("a", "FAILED", "bad"), ("b", "RUNNING", None), ("b", "RUNNING", None), ("b", "FAILED", ""),
            ("b", "RUNNING", None), ("c", "SUCCESS", None)]
    found = audit.lifecycle_events(changes(spark, rows)).orderBy("change_no").collect()
    assert [(r["execution_id"], r["event_type"]) for r in found] == [
        ("a", "STARTED"), ("a", "FAILED"), ("b", "STARTED"), ("b", "FAILED"), ("b", "RUNNING"), ("c", "STARTED")
    ]
    assert [r["message"] for r in found[1:4:2]] == ["bad", "Execution attempt failed"]
    assert found[4]["message"] == "Execution attempt completed successfully"


def test_retry_history_text(spark):
    log = spark.createDataFrame(
        [attempt("r", "FAILED", 9, 8, number=1, message="synthetic retry validation"), attempt("r", "SUCCESS", 7, 6, 3, number=2)], LOG
    )
    text = "1:FAILED:0:synthetic retry validation,2:SUCCESS:3:"
    assert [(r["page"], r["attempt_history"]) for r in audit.attempt_history(log).collect()] == [(0, text)]
    paged = {r["page"]: r["attempt_history"] for r in audit.attempt_history(log, page=1).collect()}
    assert ",".join(paged[p] for p in sorted(paged)) == text


def test_next_attempts_refuses_beyond_budget(spark):
    log = spark.createDataFrame([attempt("r", "FAILED", 9, 8, number=n) for n in (1, 2)], LOG)
    requests = spark.createDataFrame([("p", "TEST", "r", 1), ("p", "TEST", "r", 2), ("p", "TEST", "new", 1)],
                                     "pipeline_name string, environment_name string, run_id string, request long")
    got = {(r["run_id"], r["request"]): (r["attempt_number"], r["accepted"]) for r in audit.next_attempts(log, requests, ["request"]).collect()}
    assert got == {("r", 1): (3, True), ("r", 2): (4, False), ("new", 1): (1, True)}


IDENTITY = {
    "pipeline_name": "p", "environment_name": "TEST", "run_id": "r", "attempt_number": 1, "correlation_id": "p:r", "trigger_type": "MANUAL",
}


def test_audited_run(spark, tmp_path):
    path = str(tmp_path / "changes")

    def job(count_input):
        return count_input(spark.range(10)).where("id > 6")

    done = audit.audited_run(spark, IDENTITY, job, lambda df: df.write.parquet(str(tmp_path / "out")), path)
    assert (done["records_read"], done["records_written"]) == (10, 3)
    row = audit.current_log(spark.read.parquet(path)).first()
    assert row["status"] == "SUCCESS" and row["finished_at"] >= row["started_at"]


def test_audited_run_records_failure(spark, tmp_path):
    path = str(tmp_path / "changes")

    def job(count_input):
        raise ValueError("x" * 2000)

    with pytest.raises(ValueError):
        audit.audited_run(spark, IDENTITY, job, lambda df: None, path)
    row = audit.current_log(spark.read.parquet(path)).first()
    assert row["status"] == "FAILED" and len(row["error_message"]) == 1000 and row["records_written"] == 0


def test_audited_run_raises_both_errors(spark, tmp_path):
    path = tmp_path / "changes"

    def job(count_input):
        for f in path.iterdir():
            f.unlink()
        path.rmdir()
        path.write_text("in the way")
        raise ValueError("job broke")

    with pytest.raises(RuntimeError) as caught:
        audit.audited_run(spark, IDENTITY, job, lambda df: None, str(path))
    assert isinstance(caught.value.__cause__, ValueError)


def test_update_sets_finish_only_on_final_change(spark):
    log = spark.createDataFrame([attempt("r", "RUNNING", 9, None), attempt("s", "SUCCESS", 9, 8)], LOG)
    outcomes = log.select(*audit.ATTEMPT_KEY, F.lit("SUCCESS").alias("status"), F.lit(5).cast("long").alias("records_read"),
                          F.lit(5).cast("long").alias("records_written"), F.lit(None).cast("string").alias("error_message"))
    got = {r["run_id"]: r["finished_at"] for r in audit.finalize_attempts(log, outcomes, now()).collect()}
    assert got == {"r": NOW, "s": NOW - timedelta(minutes=8)}
