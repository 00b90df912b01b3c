"""Queries for the audited run and for rule checks over the log."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tracewell.operators import audit
from tracewell.plans.views import (
    AS_OF, CHANGES_SQL, LOG_SQL, RUN_ID, TARGET_SQL, as_of, exec_changes, exec_log, load, target_rows, with_sql,
)
from tracewell.scale import largest_group
from tracewell.session import work_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


def seconds(name: str):
    return F.unix_micros(name).cast("double").alias(name) / 1e6


@query(
    f"""SELECT o_orderkey, {RUN_ID} AS run_id, CASE WHEN o_custkey % 2 = 0 THEN 'DEV' ELSE 'PROD' END AS environment_name,
 CASE o_custkey % 4 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'BACKFILL' ELSE 'AIRFLOW' END AS trigger_type,
 'nightly:' || {RUN_ID} AS correlation_id FROM orders"""
)
def run_identity(spark, sf):
    orders = load(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{RUN_ID} AS run_id", "CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'Prod' END AS environment_name"
    )
    return audit.run_identity(orders, "nightly")


@query(
    with_sql(LOG_SQL)
    + """SELECT execution_id, attempt_number, 'MANUAL' AS trigger_type, CASE WHEN supplier % 2 = 0 THEN 'kept'
 ELSE pipeline_name || ':' || run_id END AS correlation_id FROM exec_log"""
)
def evolve_log(spark, sf):
    old = exec_log(spark, sf).drop("trigger_type").withColumn(
        "correlation_id", F.when(F.col("supplier") % 2 == 0, F.lit("kept"))
    )
    return audit.evolve_log(old).select("execution_id", "attempt_number", "trigger_type", "correlation_id")


@query(
    with_sql(LOG_SQL)
    + """SELECT execution_id, '{"pipeline_name":"' || pipeline_name || '","environment_name":"' || environment_name
 || '","run_id":"' || run_id || '","attempt_number":' || attempt_number || ',"correlation_id":"' || correlation_id
 || '","trigger_type":"' || trigger_type || '"}' AS metadata FROM exec_log"""
)
def event_metadata(spark, sf):
    return exec_log(spark, sf).select("execution_id", audit.event_metadata().alias("metadata"))


@query(
    f"""SELECT o_orderkey, {RUN_ID} AS run_id, 'RUNNING' AS status, CAST(epoch(TIMESTAMP '{AS_OF}') AS DOUBLE) AS started_at,
 CAST(NULL AS DOUBLE) AS finished_at, 0 AS records_read, 0 AS records_written FROM orders"""
)
def start_attempts(spark, sf):
    requests = load(spark, sf, "orders").selectExpr("o_orderkey", f"{RUN_ID} AS run_id")
    rows = audit.start_attempts(requests, as_of())
    return rows.select(
        "o_orderkey", "run_id", "status", seconds("started_at").alias("started_at"),
        seconds("finished_at").alias("finished_at"), "records_read", "records_written",
    )


OUTCOMES_SQL = """outcomes AS (SELECT pipeline_name, environment_name, run_id, attempt_number,
 CASE WHEN max(supplier) % 3 = 0 THEN 'SUCCESS' WHEN max(supplier) % 3 = 1 THEN 'FAILED' ELSE 'RUNNING' END AS status,
 sum(records_read) AS records_read, sum(records_written) AS records_written, max(execution_id) AS error_message
 FROM exec_log WHERE supplier % 2 = 0 GROUP BY 1, 2, 3, 4)"""


@query(
    with_sql(LOG_SQL, OUTCOMES_SQL)
    + f"""SELECT l.execution_id, coalesce(o.status, l.status) AS status,
 CASE WHEN o.status IN ('SUCCESS', 'FAILED') AND o.status <> l.status THEN CAST(epoch(TIMESTAMP '{AS_OF}') AS DOUBLE)
 ELSE CAST(epoch(l.finished_at) AS DOUBLE) END AS finished_at,
 CAST(CASE WHEN o.status IS NULL THEN l.records_read ELSE o.records_read END AS BIGINT) AS records_read,
 CAST(CASE WHEN o.status IS NULL THEN l.records_written ELSE o.records_written END AS BIGINT) AS records_written,
 CASE WHEN o.status IS NULL THEN l.error_message ELSE o.error_message END AS error_message
 FROM exec_log l LEFT JOIN outcomes o USING (pipeline_name, environment_name, run_id, attempt_number)"""
)
def finalize_attempts(spark, sf):
    log = exec_log(spark, sf)
    worst = F.max("supplier") % 3
    outcomes = log.where("supplier % 2 = 0").groupBy(*audit.ATTEMPT_KEY).agg(
        F.when(worst == 0, "SUCCESS").when(worst == 1, "FAILED").otherwise("RUNNING").alias("status"),
        F.sum("records_read").alias("records_read"),
        F.sum("records_written").alias("records_written"),
        F.max("execution_id").alias("error_message"),
    )
    done = audit.finalize_attempts(log, outcomes, as_of())
    return done.select(
        "execution_id", "status", seconds("finished_at").alias("finished_at"), "records_read", "records_written", "error_message"
    )


EVENTS_SQL = """seen AS (SELECT *, lag(status) OVER w AS previous, row_number() OVER w AS nth FROM exec_changes
 WINDOW w AS (PARTITION BY execution_id ORDER BY changed_at, change_no)),
lifecycle AS (SELECT execution_id, correlation_id, change_no, changed_at,
 CASE WHEN nth = 1 THEN 'STARTED' WHEN status = 'SUCCESS' THEN 'SUCCEEDED' ELSE status END AS event_type,
 CASE WHEN nth = 1 THEN 'Execution attempt started'
 WHEN status = 'FAILED' THEN coalesce(nullif(error_message, ''), 'Execution attempt failed')
 ELSE 'Execution attempt completed successfully' END AS message FROM seen WHERE nth = 1 OR status <> previous)"""


@query(
    with_sql(LOG_SQL, CHANGES_SQL, EVENTS_SQL)
    + """SELECT execution_id, event_type, CAST(epoch(changed_at) AS DOUBLE) AS event_at, change_no, message FROM lifecycle"""
)
def lifecycle_events(spark, sf):
    events = audit.lifecycle_events(exec_changes(spark, sf))
    return events.select("execution_id", "event_type", seconds("event_at").alias("event_at"), "change_no", "message")


@query(
    with_sql(LOG_SQL, CHANGES_SQL, EVENTS_SQL)
    + """SELECT e.execution_id, e.event_type, l.pipeline_name, l.environment_name, l.run_id, l.attempt_number, l.correlation_id
 FROM lifecycle e JOIN exec_log l ON e.execution_id = l.execution_id"""
)
def run_events(spark, sf):
    changes = exec_changes(spark, sf)
    sizes = largest_group(changes, ["execution_id"])
    events = audit.lifecycle_events(changes, sizes=sizes).select("execution_id", "event_type")
    return audit.run_events(events, exec_log(spark, sf), sizes)


@query(
    with_sql(
        LOG_SQL, CHANGES_SQL, EVENTS_SQL,
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY changed_at, execution_id, change_no) AS nth FROM lifecycle)""",
    )
    + """SELECT correlation_id, (nth - 1) // 1000 AS page, string_agg(event_type, ',' ORDER BY nth) AS event_sequence
 FROM numbered GROUP BY 1, 2"""
)
def event_sequence(spark, sf):
    changes = exec_changes(spark, sf)
    by_attempt, by_run = (largest_group(changes, [key]) for key in ("execution_id", "correlation_id"))
    events = audit.run_events(audit.lifecycle_events(changes, sizes=by_attempt), exec_log(spark, sf), by_attempt)
    return audit.event_sequence(events, ("event_at", "execution_id", "change_no"), sizes=by_run)


@query(
    with_sql(
        LOG_SQL,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY attempt_number, execution_id) AS nth FROM exec_log)",
    )
    + """SELECT correlation_id, (nth - 1) // 1000 AS page, string_agg(attempt_number || ':' || status || ':' || records_written || ':' ||
 coalesce(error_message, ''), ',' ORDER BY nth) AS attempt_history FROM numbered GROUP BY 1, 2"""
)
def attempt_history(spark, sf):
    return audit.attempt_history(exec_log(spark, sf))


@query(
    with_sql(LOG_SQL)
    + """SELECT execution_id, correlation_id, row_number() OVER w AS attempt_position, lag(status) OVER w AS previous_status,
 last_value(status) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_status,
 count(*) OVER (PARTITION BY correlation_id) AS attempts,
 count(*) FILTER (WHERE status = 'FAILED') OVER (PARTITION BY correlation_id) AS failed_attempts,
 row_number() OVER w = count(*) OVER (PARTITION BY correlation_id) AS is_final FROM exec_log
 WINDOW w AS (PARTITION BY correlation_id ORDER BY attempt_number, execution_id)"""
)
def retry_chain(spark, sf):
    columns = "execution_id correlation_id attempt_position previous_status final_status attempts failed_attempts is_final"
    return audit.retry_chain(exec_log(spark, sf)).select(*columns.split())


REQUESTS_SQL = f"""requests AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, o_orderpriority AS pipeline_name,
 CASE o_custkey % 3 WHEN 0 THEN 'DEV' WHEN 1 THEN 'TEST' ELSE 'PROD' END AS environment_name, {RUN_ID} AS run_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""


@query(
    with_sql(LOG_SQL, REQUESTS_SQL)
    + """SELECT *, attempt_number <= 3 AS accepted FROM (SELECT r.*, coalesce(h.last, 0) + row_number() OVER (
 PARTITION BY r.pipeline_name, r.environment_name, r.run_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS attempt_number
 FROM requests r LEFT JOIN (SELECT pipeline_name, environment_name, run_id, max(attempt_number) AS last FROM exec_log
 WHERE attempt_number < 3 GROUP BY 1, 2, 3) h USING (pipeline_name, environment_name, run_id))"""
)
def next_attempts(spark, sf):
    items = load(spark, sf, "lineitem").where("l_returnflag = 'R'")
    requests = items.join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "o_orderpriority AS pipeline_name",
        "CASE o_custkey % 3 WHEN 0 THEN 'DEV' WHEN 1 THEN 'TEST' ELSE 'PROD' END AS environment_name", f"{RUN_ID} AS run_id",
    )
    history = exec_log(spark, sf).where("attempt_number < 3")
    return audit.next_attempts(history, requests, ["l_linenumber", "l_partkey", "l_suppkey"])


@query(
    with_sql(LOG_SQL, TARGET_SQL)
    + """SELECT t.record_id, CAST(t.amount AS DOUBLE) AS amount, l.execution_id, l.status, CAST(epoch(l.started_at) AS DOUBLE) AS started_at
 FROM target_rows t JOIN exec_log l ON l.run_id = t.run_id AND l.attempt_number = t.attempt_number"""
)
def trace_rows(spark, sf):
    rows = audit.trace_rows(target_rows(spark, sf), exec_log(spark, sf))
    return rows.select(
        "record_id", F.col("amount").cast("double").alias("amount"), "execution_id", "status",
        seconds("started_at").alias("started_at"),
    )


@query(
    with_sql(LOG_SQL, TARGET_SQL)
    + """SELECT run_id, coalesce(t.row_count, 0) AS row_count, coalesce(t.amount_sum, '0.00') AS amount_sum,
 coalesce(l.unfinished, 0) AS unfinished
 FROM (SELECT run_id, count(*) AS row_count, CAST(sum(amount) AS VARCHAR) AS amount_sum FROM target_rows GROUP BY 1) t
 FULL JOIN (SELECT run_id, count(*) FILTER (WHERE finished_at IS NULL) AS unfinished FROM exec_log GROUP BY 1) l USING (run_id)"""
)
def load_summary(spark, sf):
    return audit.load_summary(target_rows(spark, sf), exec_log(spark, sf), ["run_id"])


@query(
    with_sql(LOG_SQL)
    + """SELECT pipeline_name, environment_name, run_id, attempt_number, status, records_written,
 CAST(epoch(started_at) AS DOUBLE) AS started_at, CAST(epoch(finished_at) AS DOUBLE) AS finished_at, execution_id FROM exec_log"""
)
def recent_executions(spark, sf):
    recent = audit.recent_executions(exec_log(spark, sf))
    return recent.withColumns({c: seconds(c) for c in ("started_at", "finished_at")})


@query(
    with_sql(LOG_SQL)
    + f"""SELECT execution_id, pipeline_name, run_id, attempt_number FROM exec_log
 WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE"""
)
def stale_running(spark, sf):
    stale = audit.stale_running(exec_log(spark, sf), as_of())
    return stale.select("execution_id", "pipeline_name", "run_id", "attempt_number")


@query(
    with_sql(LOG_SQL, CHANGES_SQL)
    + """SELECT pipeline_name, environment_name, run_id, attempt_number, CAST(epoch(min(changed_at)) AS DOUBLE) AS started_at,
 arg_max(status, (changed_at, status <> 'RUNNING')) AS status FROM (SELECT * EXCLUDE (attempt_number),
 dense_rank() OVER (PARTITION BY pipeline_name, environment_name, run_id ORDER BY attempt_number, execution_id) AS attempt_number
 FROM exec_changes) GROUP BY 1, 2, 3, 4"""
)
def current_log(spark, sf):
    """All changes; executions that share an attempt number get numbers of their own, in order, within the run."""
    run = Window.partitionBy("pipeline_name", "environment_name", "run_id").orderBy("attempt_number", "execution_id")
    changes = exec_changes(spark, sf).withColumn("attempt_number", F.dense_rank().over(run))
    log = audit.current_log(changes)
    return log.select(*audit.ATTEMPT_KEY, seconds("started_at").alias("started_at"), "status")


@query(
    """SELECT 'SUCCESS' AS status, count(*) AS records_read, count(*) FILTER (WHERE l_returnflag = 'R') AS records_written
 FROM lineitem UNION ALL SELECT 'RUNNING', 0, 0"""
)
def audited_run(spark, sf):
    changes, target = work_path(spark, "changes"), work_path(spark, "target")
    identity = {
        "pipeline_name": "returns", "environment_name": "TEST", "run_id": "manual__1", "attempt_number": 1,
        "correlation_id": "returns:manual__1", "trigger_type": "MANUAL",
    }

    def job(count_input):
        return count_input(load(spark, sf, "lineitem")).where("l_returnflag = 'R'")

    audit.audited_run(spark, identity, job, lambda rows: rows.write.parquet(target), changes)
    return spark.read.parquet(changes).select("status", "records_read", "records_written")
