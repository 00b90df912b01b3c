"""Queries that run the streams over stored changes; each equals a batch SQL text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tracewell.functions.numeric import epoch_seconds
from tracewell.plans.views import LOG_SQL, exec_log, load, with_sql
from tracewell.session import work_path
from tracewell.streaming import lifecycle

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


STATUS = "CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END"
CHANGE_COLUMNS = [
    "concat('user-', user_id) AS execution_id", f"{STATUS} AS status", "CAST(ts AS TIMESTAMP) AS changed_at",
    "event_id AS change_no", "CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN concat('code ', event_id) END AS error_message",
]
USER_CHANGES_SQL = f"changes AS (SELECT {', '.join(CHANGE_COLUMNS)} FROM events)"


BATCHES = 4


def _changes(spark, sf):
    return load(spark, sf, "events").selectExpr(*CHANGE_COLUMNS)


def _time_slice(changes):
    """Number of the slice of a change when all of them arrive in BATCHES parts, in order of time."""
    cuts = changes.select(F.unix_micros("changed_at").alias("t")).approxQuantile("t", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    return sum(((F.unix_micros("changed_at") > int(c)).cast("int") for c in cuts), F.lit(0))


def _run(spark, stored, build, name, part=None):
    """Let rows arrive as files, in BATCHES parts where ``part`` numbers them, and run the stream after each."""
    path = work_path(spark, name)

    def arrive(i):
        (stored if part is None else stored.where(part == i)).write.mode("append").parquet(path)

    arrive(0)
    stream = build(spark.readStream.schema(stored.schema).parquet(path))
    later = [partial(arrive, i) for i in range(1, 1 if part is None else BATCHES)]
    return lifecycle.run_available(stream, name, spark.sparkContext.defaultParallelism, later)


@query(
    with_sql(
        USER_CHANGES_SQL,
        "seen AS (SELECT *, lag(status) OVER (PARTITION BY execution_id ORDER BY changed_at, change_no) AS previous FROM changes)",
    )
    + """SELECT execution_id, CASE WHEN previous IS NULL THEN 'STARTED' WHEN status = 'SUCCESS' THEN 'SUCCEEDED' ELSE status END AS event_type,
 CAST(epoch_us(changed_at) AS DOUBLE) / 1e6 AS event_at, CASE WHEN previous IS NULL THEN 'Execution attempt started'
 WHEN status = 'FAILED' THEN coalesce(error_message, 'Execution attempt failed') ELSE 'Execution attempt completed successfully' END AS message
 FROM seen WHERE previous IS NULL OR status <> previous"""
)
def stream_lifecycle(spark, sf):
    changes = _changes(spark, sf)
    events = _run(spark, changes, lifecycle.stream_lifecycle, "lifecycle", _time_slice(changes))
    return events.withColumn("event_at", epoch_seconds(F.col("event_at")))


@query(
    with_sql(
        USER_CHANGES_SQL,
        """ended AS (SELECT execution_id, max(changed_at) FILTER (WHERE status <> 'RUNNING') AS last_end FROM changes GROUP BY 1),
 open AS (SELECT c.execution_id, min(c.changed_at) AS started_at FROM changes c JOIN ended e USING (execution_id)
 WHERE c.status = 'RUNNING' AND (e.last_end IS NULL OR c.changed_at > e.last_end) GROUP BY 1)""",
    )
    + """SELECT execution_id, CAST(epoch_us(started_at) AS DOUBLE) / 1e6 AS started_at FROM open
 WHERE started_at + INTERVAL 30 MINUTE <= (SELECT max(changed_at) FROM changes) - INTERVAL 10 MINUTE"""
)
def stream_stale(spark, sf):
    stale = _run(spark, _changes(spark, sf), lifecycle.stream_stale, "stale")
    return stale.withColumn("started_at", epoch_seconds(F.col("started_at")))


@query(
    with_sql(USER_CHANGES_SQL)
    + """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, changed_at)) AS DOUBLE) AS window_start,
 CAST(epoch(time_bucket(INTERVAL 1 HOUR, changed_at)) + 3600 AS DOUBLE) AS window_end, status, count(*) AS changes FROM changes
 WHERE time_bucket(INTERVAL 1 HOUR, changed_at) + INTERVAL 1 HOUR <= (SELECT max(changed_at) FROM changes) - INTERVAL 10 MINUTE
 GROUP BY 1, 2, 3"""
)
def stream_status_counts(spark, sf):
    changes = _changes(spark, sf)
    count = partial(lifecycle.stream_status_counts, window="1 hour", delay="10 minutes")
    counts = _run(spark, changes, count, "counts", _time_slice(changes))
    return counts.withColumns({c: epoch_seconds(F.col(c)) for c in ("window_start", "window_end")})


@query(with_sql(LOG_SQL) + "SELECT DISTINCT pipeline_name, environment_name, run_id, attempt_number FROM exec_log")
def stream_dedupe(spark, sf):
    log = exec_log(spark, sf).select("pipeline_name", "environment_name", "run_id", "attempt_number", "started_at")
    # Every part spans all times, and every fifth run arrives again in the part after its own.
    part = F.pmod(F.xxhash64("run_id"), F.lit(BATCHES))
    again = log.where(F.pmod(F.xxhash64("run_id", F.lit(1)), F.lit(5)) == 0).withColumn("part", F.pmod(part + 1, F.lit(BATCHES)))
    arriving = log.withColumn("part", part).unionByName(again)
    return _run(spark, arriving, lifecycle.stream_dedupe, "dedupe", F.col("part")).drop("started_at", "part")
