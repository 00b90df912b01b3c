"""Queries for metrics, service levels, alerts and dashboard reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import numeric
from tracewell.operators import observability as obs
from tracewell.plans.views import AS_OF, LOG_SQL, SAMPLES_SQL, as_of, exec_log, samples, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


TOTALS_SQL = """totals AS (SELECT pipeline_name, environment_name, status, CAST(count(*) AS DOUBLE) AS run_count FROM exec_log
 WHERE status IN ('SUCCESS', 'FAILED') GROUP BY 1, 2, 3)"""
METRICS_SQL = f"""metrics AS (SELECT pipeline_name, environment_name,
 CAST(count(*) FILTER (WHERE attempt_number > 1) AS DOUBLE) AS retry_count,
 CAST(count(*) FILTER (WHERE status = 'FAILED') AS DOUBLE) AS failure_count,
 CAST(coalesce(sum(records_written), 0) AS DOUBLE) AS records_written,
 CAST(count(*) FILTER (WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE) AS DOUBLE) AS stale_running,
 CAST(coalesce(epoch(max(finished_at) FILTER (WHERE status = 'SUCCESS')), 0) AS DOUBLE) AS last_success_timestamp_seconds,
 round(coalesce(avg(epoch(finished_at) - epoch(started_at)) FILTER (WHERE finished_at IS NOT NULL), 0), 6) AS average_duration_seconds,
 round(coalesce(quantile_cont(CAST(epoch(finished_at) - epoch(started_at) AS DOUBLE), 0.95) FILTER (WHERE finished_at IS NOT NULL), 0), 6)
 AS p95_duration_seconds FROM exec_log GROUP BY 1, 2)"""
EXPOSED_SQL = """exposed AS (
SELECT 'etl_pipeline_run_total' AS metric, 'counter' AS kind, pipeline_name, environment_name, status, run_count AS value FROM totals
UNION ALL SELECT 'etl_pipeline_failure_total', 'counter', pipeline_name, environment_name, NULL, failure_count FROM metrics
UNION ALL SELECT 'etl_pipeline_retry_total', 'counter', pipeline_name, environment_name, NULL, retry_count FROM metrics
UNION ALL SELECT 'etl_records_written_total', 'counter', pipeline_name, environment_name, NULL, records_written FROM metrics
UNION ALL SELECT 'etl_running_stale_total', 'gauge', pipeline_name, environment_name, NULL, stale_running FROM metrics
UNION ALL SELECT 'etl_last_success_timestamp_seconds', 'gauge', pipeline_name, environment_name, NULL, last_success_timestamp_seconds FROM metrics
UNION ALL SELECT 'etl_pipeline_duration_seconds', 'gauge', pipeline_name, environment_name, NULL, average_duration_seconds FROM metrics
UNION ALL SELECT 'etl_pipeline_duration_p95_seconds', 'gauge', pipeline_name, environment_name, NULL, p95_duration_seconds FROM metrics)"""
ALL_SQL = with_sql(LOG_SQL, TOTALS_SQL, METRICS_SQL, EXPOSED_SQL)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def exposed(spark, sf):
    found = obs.expose_metrics(exec_log(spark, sf), as_of())
    return rounded(obs.with_labels(found, ["pipeline_name", "environment_name", "status"]), "value")


@query(with_sql(LOG_SQL, TOTALS_SQL) + "SELECT * FROM totals")
def status_totals(spark, sf):
    return obs.status_totals(exec_log(spark, sf))


@query(with_sql(LOG_SQL, METRICS_SQL) + "SELECT * FROM metrics")
def runtime_metrics(spark, sf):
    found = obs.runtime_metrics(exec_log(spark, sf), as_of())
    return rounded(found, "average_duration_seconds", "p95_duration_seconds")


@query(ALL_SQL + "SELECT * FROM exposed")
def expose_metrics(spark, sf):
    return exposed(spark, sf).drop("labels")


@query(
    ALL_SQL
    + """SELECT * FROM exposed WHERE regexp_full_match(pipeline_name, '[1-3]-.*') AND environment_name = 'PROD'
 AND regexp_full_match(metric, 'etl_pipeline.*')"""
)
def match_labels(spark, sf):
    patterns = {"pipeline_name": "[1-3]-.*", "environment_name": "PROD", "metric": "etl_pipeline.*", "status": ".*"}
    found = obs.match_labels(obs.expose_metrics(exec_log(spark, sf), as_of()), patterns)
    return rounded(obs.with_labels(found, ["pipeline_name", "environment_name", "status"]), "value").drop("labels")


@query(ALL_SQL + "SELECT metric, environment_name, round(sum(value), 4) AS value FROM exposed GROUP BY 1, 2")
def sum_by(spark, sf):
    summed = obs.sum_by(exposed(spark, sf), ["metric", "environment_name"])
    return summed.withColumn("value", F.round("value", 4))


@query("SELECT DISTINCT o_orderpriority AS pipeline_name FROM orders")
def label_values(spark, sf):
    totals = obs.status_totals(exec_log(spark, sf)).withColumn("value", F.col("run_count"))
    return obs.label_values(totals, "pipeline_name")


@query(
    ALL_SQL
    + """SELECT f.pipeline_name, f.environment_name, round(f.value / r.value, 6) AS value
 FROM exposed f JOIN exposed r USING (pipeline_name, environment_name)
 WHERE f.metric = 'etl_pipeline_failure_total' AND r.metric = 'etl_pipeline_retry_total' AND r.value > 0 AND r.pipeline_name <> '1-URGENT'"""
)
def vector_join(spark, sf):
    all_samples = exposed(spark, sf).drop("labels")
    failures = all_samples.where(F.col("metric") == "etl_pipeline_failure_total")
    retries = all_samples.where(
        (F.col("metric") == "etl_pipeline_retry_total") & (F.col("value") > 0) & (F.col("pipeline_name") != "1-URGENT")
    )
    return rounded(obs.vector_join(failures, retries, obs.SERIES, lambda a, b: a / b), "value")


SLO_SQL = """slo AS (SELECT *, round(1 - r, 6) AS error_ratio, round(greatest(1 - (1 - r) / 0.01, 0), 6) AS budget_remaining FROM (
 SELECT pipeline_name, environment_name, sum(run_count) FILTER (WHERE status = 'SUCCESS') / greatest(sum(run_count), 1) AS r
 FROM totals GROUP BY 1, 2) WHERE r IS NOT NULL)"""


@query(
    with_sql(LOG_SQL, TOTALS_SQL, SLO_SQL)
    + "SELECT pipeline_name, environment_name, round(r, 6) AS success_ratio, error_ratio, budget_remaining FROM slo"
)
def slo(spark, sf):
    return rounded(obs.slo(obs.status_totals(exec_log(spark, sf))), "success_ratio", "error_ratio", "budget_remaining")


@query(
    with_sql(LOG_SQL, METRICS_SQL)
    + f"""SELECT pipeline_name, environment_name, CAST(epoch(TIMESTAMP '{AS_OF}') - last_success_timestamp_seconds AS DOUBLE)
 AS success_age_seconds FROM metrics"""
)
def success_age(spark, sf):
    return obs.success_age(obs.runtime_metrics(exec_log(spark, sf), as_of()), as_of())


LATE = "2001-11-04 02:00:00"
ALERTS_SQL = f"""late AS (SELECT pipeline_name, environment_name,
 count(*) FILTER (WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{LATE}' - INTERVAL 30 MINUTE) AS stale,
 epoch(TIMESTAMP '{LATE}') - coalesce(epoch(max(finished_at) FILTER (WHERE status = 'SUCCESS')), 0) AS age,
 max(finished_at) FILTER (WHERE status = 'SUCCESS') IS NOT NULL AS ever FROM exec_log GROUP BY 1, 2),
found AS (SELECT 'ETLPipelineSLOBreach' AS alertname, pipeline_name, environment_name, 'warning' AS severity, 'firing' AS state,
 'ETL success SLO is below 99%' AS summary, 'Pipeline ' || pipeline_name || ' in ' || environment_name || ' has success ratio '
 || printf('%.6f', r) || '.' AS description FROM slo WHERE r < 0.99
UNION ALL SELECT 'ETLStaleRunningExecution', pipeline_name, environment_name, 'critical', 'firing', 'ETL execution is stale',
 'Pipeline ' || pipeline_name || ' in ' || environment_name || ' has stale RUNNING attempts.' FROM late WHERE stale > 0
UNION ALL SELECT 'ETLNoRecentSuccess', pipeline_name, environment_name, 'warning', CASE WHEN age >= 3900 THEN 'firing' ELSE 'pending' END,
 'ETL has no recent success', 'Pipeline ' || pipeline_name || ' in ' || environment_name || ' has not succeeded within one hour.'
 FROM late WHERE age > 3600 AND ever)"""


def late():
    return F.lit(LATE).cast("timestamp")


@query(with_sql(LOG_SQL, TOTALS_SQL, SLO_SQL, ALERTS_SQL) + "SELECT * FROM found")
def alerts(spark, sf):
    return obs.alerts(exec_log(spark, sf), late())


@query(
    with_sql(LOG_SQL, TOTALS_SQL, SLO_SQL, ALERTS_SQL)
    + """SELECT alertname, pipeline_name, environment_name, count(*) AS alert_count,
 count(*) FILTER (WHERE state = 'firing') AS firing_count, max(severity) AS severity FROM found GROUP BY 1, 2, 3"""
)
def group_alerts(spark, sf):
    return obs.group_alerts(obs.alerts(exec_log(spark, sf), late()))


@query(
    ALL_SQL
    + f"""SELECT pipeline_name, environment_name, CASE WHEN stale_running >= 1 THEN 'red' ELSE 'green' END AS stale_band,
 CASE WHEN age >= 3600 THEN 'red' WHEN age >= 1800 THEN 'orange' ELSE 'green' END AS age_band,
 CASE WHEN share >= 0.5 THEN 'green' WHEN share >= 0.25 THEN 'orange' ELSE 'red' END AS share_band
 FROM (SELECT *, epoch(TIMESTAMP '{AS_OF}') - last_success_timestamp_seconds AS age, failure_count / greatest(retry_count, 1) AS share FROM metrics)"""
)
def band(spark, sf):
    found = obs.runtime_metrics(exec_log(spark, sf), as_of())
    age = numeric.epoch_seconds(as_of()) - F.col("last_success_timestamp_seconds")
    share = numeric.safe_ratio(F.col("failure_count"), F.col("retry_count"))
    return found.select(
        *obs.SERIES,
        numeric.band(F.col("stale_running"), numeric.STALE_STEPS).alias("stale_band"),
        numeric.band(age, numeric.AGE_STEPS).alias("age_band"),
        numeric.band(share, numeric.BUDGET_STEPS).alias("share_band"),
    )


@query(
    with_sql(SAMPLES_SQL)
    + """SELECT series, arg_max(value, ts) AS value, CAST(epoch_us(max(ts)) AS DOUBLE) / 1e6 AS ts FROM samples
 WHERE value IS NOT NULL GROUP BY series"""
)
def last_not_null(spark, sf):
    found = obs.last_not_null(samples(spark, sf), ["series"])
    return found.withColumn("ts", numeric.epoch_seconds(F.col("ts")))


@query(
    with_sql(
        SAMPLES_SQL,
        """flagged AS (SELECT *, coalesce(value > 20, false) AS is_on FROM samples),
 marked AS (SELECT *, sum(CASE WHEN is_on THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS island FROM flagged),
 held AS (SELECT *, min(ts) FILTER (WHERE is_on) OVER (PARTITION BY series, island) AS since FROM marked)""",
    )
    + """SELECT series, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS ts, value, CASE WHEN NOT is_on THEN 'inactive'
 WHEN epoch_us(ts) - epoch_us(since) >= 86400000000 THEN 'firing' ELSE 'pending' END AS state FROM held"""
)
def alert_state(spark, sf):
    states = obs.alert_state(samples(spark, sf), ["series"], F.col("value") > 20, 86400)
    return states.withColumn("ts", numeric.epoch_seconds(F.col("ts")))


@query(
    with_sql(LOG_SQL)
    + """SELECT s.pipeline_name, s.environment_name, s.status, CAST(epoch(g.ts) AS DOUBLE) AS ts, CAST(count(l.finished_at) AS DOUBLE) AS value
 FROM (SELECT DISTINCT pipeline_name, environment_name, status FROM exec_log WHERE finished_at <= TIMESTAMP '2001-12-31') s
 CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1995-06-01', TIMESTAMP '2001-12-31', INTERVAL 30 DAY)) AS ts) g
 LEFT JOIN exec_log l ON l.pipeline_name = s.pipeline_name AND l.environment_name = s.environment_name AND l.status = s.status
 AND l.finished_at <= g.ts GROUP BY ALL"""
)
def sample_metrics(spark, sf):
    first, last = (F.lit(t).cast("timestamp") for t in ("1995-06-01", "2001-12-31"))
    found = obs.sample_metrics(exec_log(spark, sf), first, last, F.expr("INTERVAL 30 DAY"))
    return found.withColumn("ts", numeric.epoch_seconds(F.col("ts")))
