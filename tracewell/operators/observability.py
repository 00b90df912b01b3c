"""Metrics, service-level ratios, alerts and dashboard reductions over the log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.numeric import clamp_min, duration_seconds, epoch_seconds
from tracewell.operators.audit import STALE_SECONDS
from tracewell.scale import exact_percentile, running
from tracewell.session import written

SERIES = ["pipeline_name", "environment_name"]

# Metric name -> (kind, column of the wide view).
RUN_TOTAL = "etl_pipeline_run_total"
METRICS = {
    "etl_pipeline_failure_total": ("counter", "failure_count"),
    "etl_pipeline_retry_total": ("counter", "retry_count"),
    "etl_records_written_total": ("counter", "records_written"),
    "etl_running_stale_total": ("gauge", "stale_running"),
    "etl_last_success_timestamp_seconds": ("gauge", "last_success_timestamp_seconds"),
    "etl_pipeline_duration_seconds": ("gauge", "average_duration_seconds"),
    "etl_pipeline_duration_p95_seconds": ("gauge", "p95_duration_seconds"),
}
# Objective, error budget, alert limits.
OBJECTIVE = 0.99
ERROR_BUDGET = 0.01
NO_SUCCESS_SECONDS = 3600
NO_SUCCESS_HOLD = 300


def status_totals(log: DataFrame) -> DataFrame:
    """Completed attempts by pipeline, environment and final status."""
    return (
        log.where(F.col("status").isin("SUCCESS", "FAILED"))
        .groupBy(*SERIES, "status")
        .agg(F.count(F.lit(1)).cast("double").alias("run_count"))
    )


def runtime_metrics(log: DataFrame, as_of: Column, percentile: str = "exact") -> DataFrame:
    """Retries, failures, rows written, stale attempts, last success, mean and 95th percentile duration.

    The log is read once, into one row per series and duration. That table is written, because both the sums and
    the exact percentile come from it. ``percentile="approx"`` needs no such table.
    """
    finished = F.col("status").isin("SUCCESS", "FAILED") & F.col("finished_at").isNotNull()
    timed = log.withColumn("_d", F.when(finished, duration_seconds(F.col("started_at"), F.col("finished_at"))))
    is_stale = (F.col("status") == "RUNNING") & (
        F.col("started_at") < as_of - F.make_dt_interval(secs=F.lit(STALE_SECONDS))
    )
    counts = {
        "retry_count": F.count_if(F.col("attempt_number") > 1),
        "failure_count": F.count_if(F.col("status") == "FAILED"),
        "records_written": F.coalesce(F.sum("records_written"), F.lit(0)),
        "stale_running": F.count_if(is_stale),
    }
    success = F.max(F.when(F.col("status") == "SUCCESS", F.col("finished_at")))

    def last_success(value: Column) -> Column:
        return F.coalesce(epoch_seconds(value), F.lit(0.0)).alias("last_success_timestamp_seconds")

    if percentile == "approx":
        return timed.groupBy(*SERIES).agg(
            *[c.cast("double").alias(n) for n, c in counts.items()],
            last_success(success),
            F.coalesce(F.avg("_d"), F.lit(0.0)).alias("average_duration_seconds"),
            F.coalesce(F.percentile_approx("_d", 0.95), F.lit(0.0)).cast("double").alias("p95_duration_seconds"),
        )
    per_duration = written(
        timed.groupBy(*SERIES, "_d").agg(
            *[c.alias(n) for n, c in counts.items()], success.alias("_success"), F.count(F.lit(1)).alias("_n")
        ),
        "durations",
    )
    exact = exact_percentile(per_duration, SERIES, "_d", 0.95, "p95_duration_seconds", weight="_n")
    attempts = F.sum(F.when(F.col("_d").isNotNull(), F.col("_n")))
    return (
        per_duration.groupBy(*SERIES)
        .agg(
            *[F.sum(n).cast("double").alias(n) for n in counts],
            last_success(F.max("_success")),
            F.coalesce(F.sum(F.col("_d") * F.col("_n")) / attempts, F.lit(0.0)).alias("average_duration_seconds"),
        )
        .join(exact, SERIES, "left")
        .withColumn("p95_duration_seconds", F.coalesce("p95_duration_seconds", F.lit(0.0)))
    )


def expose_metrics(log: DataFrame, as_of: Column) -> DataFrame:
    """The eight metrics as labelled samples: metric, kind, labels, value."""
    labels = [F.lit("pipeline_name"), F.col("pipeline_name"), F.lit("environment_name"), F.col("environment_name")]
    totals = status_totals(log).select(
        F.lit(RUN_TOTAL).alias("metric"),
        F.lit("counter").alias("kind"),
        F.create_map(*labels, F.lit("status"), F.col("status")).alias("labels"),
        F.col("run_count").alias("value"),
    )
    samples = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(kind).alias("kind"), F.col(c).cast("double").alias("value"))
            for m, (kind, c) in METRICS.items()
        ]
    )
    wide = runtime_metrics(log, as_of).select(F.create_map(*labels).alias("labels"), F.explode(samples).alias("s"))
    return totals.unionByName(wide.select("s.metric", "s.kind", "labels", "s.value"))


def match_labels(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Keep samples whose labels match fully anchored patterns; ``.*`` also matches an absent label."""
    keep = F.lit(True)
    for label, pattern in patterns.items():
        value = F.col(label) if label in df.columns else F.col("labels")[label]
        keep = keep & F.coalesce(value, F.lit("")).rlike(f"^(?:{pattern})$")
    return df.where(keep)


def with_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Labels of a sample as plain columns."""
    return df.withColumns({c: F.col("labels")[c] for c in labels})


def sum_by(df: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    """Sum per label set; the total when no labels are named."""
    return df.groupBy(*labels).agg(F.sum(value).alias(value))


def label_values(df: DataFrame, label: str) -> DataFrame:
    value = F.col(label) if label in df.columns else F.col("labels")[label]
    return df.select(value.alias(label)).where(F.col(label).isNotNull()).distinct().orderBy(label)


def vector_join(left: DataFrame, right: DataFrame, on: Sequence[str], op) -> DataFrame:
    """Combine two vectors on identical labels; labels absent on one side give no row."""
    l = left.select(*on, F.col("value").alias("_l"))
    r = right.select(*on, F.col("value").alias("_r"))
    return l.join(r, list(on)).select(*on, op(F.col("_l"), F.col("_r")).alias("value"))


def slo(totals: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Success ratio, error ratio and what is left of the error budget.

    A series without any success has no ratio, because both vectors must carry the label;
    ``zero_fill`` counts it as zero successes instead.
    """
    per = totals.groupBy(*SERIES).agg(
        F.sum(F.when(F.col("status") == "SUCCESS", F.col("run_count"))).alias("_ok"),
        F.sum("run_count").alias("_all"),
    )
    per = per.withColumn("_ok", F.coalesce("_ok", F.lit(0.0))) if zero_fill else per.where(F.col("_ok").isNotNull())
    ratio = F.col("_ok") / clamp_min(F.col("_all"), 1.0)
    return (
        per.withColumn("success_ratio", ratio)
        .withColumn("error_ratio", F.lit(1.0) - F.col("success_ratio"))
        .withColumn("budget_remaining", clamp_min(F.lit(1.0) - F.col("error_ratio") / F.lit(ERROR_BUDGET), 0.0))
        .select(*SERIES, "success_ratio", "error_ratio", "budget_remaining")
    )


def success_age(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Seconds since the last success; a series that never succeeded counts from 1970."""
    age = epoch_seconds(as_of) - F.col("last_success_timestamp_seconds")
    return metrics.select(*SERIES, age.alias("success_age_seconds"))


def alerts(log: DataFrame, as_of: Column) -> DataFrame:
    """Alerts that hold at ``as_of``, as pending or firing, with their texts.

    The no-success condition holds from one hour after the last success on, so its hold time follows from the log.
    """
    metrics = runtime_metrics(log, as_of, percentile="approx")
    breach = slo(status_totals(log)).where(F.col("success_ratio") < OBJECTIVE)
    now = epoch_seconds(as_of)
    last = F.col("last_success_timestamp_seconds")
    waited = now - last - NO_SUCCESS_SECONDS

    def alert(df: DataFrame, name: str, severity: str, summary: str, text: Column, state: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("alertname"), *SERIES, F.lit(severity).alias("severity"),
            state.alias("state"),
            F.lit(summary).alias("summary"), text.alias("description"),
        )

    where = (F.lit("Pipeline "), F.col("pipeline_name"), F.lit(" in "), F.col("environment_name"))
    firing = F.lit("firing")
    return (
        alert(
            breach, "ETLPipelineSLOBreach", "warning", "ETL success SLO is below 99%",
            F.concat(*where, F.lit(" has success ratio "), F.format_string("%.6f", "success_ratio"), F.lit(".")), firing,
        )
        .unionByName(
            alert(
                metrics.where(F.col("stale_running") > 0), "ETLStaleRunningExecution", "critical",
                "ETL execution is stale", F.concat(*where, F.lit(" has stale RUNNING attempts.")), firing,
            )
        )
        .unionByName(
            alert(
                metrics.where((waited > 0) & (last > 0)), "ETLNoRecentSuccess", "warning",
                "ETL has no recent success", F.concat(*where, F.lit(" has not succeeded within one hour.")),
                F.when(waited >= NO_SUCCESS_HOLD, firing).otherwise(F.lit("pending")),
            )
        )
    )


def group_alerts(found: DataFrame) -> DataFrame:
    """Alerts in notification groups by name, pipeline and environment."""
    return found.groupBy("alertname", *SERIES).agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if(F.col("state") == "firing").alias("firing_count"),
        F.max("severity").alias("severity"),
    )


def last_not_null(samples: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Latest sample of each series that has a value."""
    return (
        samples.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
    )


def alert_state(
    samples: DataFrame, keys: Sequence[str], condition: Column, hold_seconds: float, ts: str = "ts"
) -> DataFrame:
    """State of each sample: inactive, pending, or firing once the condition has held for ``hold_seconds``.

    ``ts`` must be unique per series.
    """
    flagged = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    marked = running(flagged, keys, [ts], {"_was": ("lag", "_on")})
    starts = F.when(F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False)), F.col(ts))
    since = running(marked.withColumn("_start", starts), keys, [ts], {"_since": ("max", "_start")})
    held = duration_seconds(F.col("_since"), F.col(ts))
    state = F.when(~F.col("_on"), "inactive").when(held >= hold_seconds, "firing").otherwise("pending")
    return since.withColumn("state", state).select(*samples.columns, "state")


def sample_metrics(log: DataFrame, first: Column, last: Column, every: Column) -> DataFrame:
    """Cumulative completed attempts per series and status at each sampling tick.

    Attempts are first counted per tick, so that the running sum sees one row per series and tick.
    """
    done = log.where(F.col("status").isin("SUCCESS", "FAILED") & (F.col("finished_at") <= last))
    step = F.unix_micros(first + every) - F.unix_micros(first)
    offset = F.unix_micros(F.greatest(F.col("finished_at"), first)) - F.unix_micros(first)
    labels = [*SERIES, "status"]
    counted = done.groupBy(*labels, F.ceil(offset / step).cast("long").alias("_tick")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    last_tick = F.floor((F.unix_micros(last) - F.unix_micros(first)) / step).cast("long")
    grid = counted.select(*labels).distinct().select(*labels, F.explode(F.sequence(F.lit(0).cast("long"), last_tick)).alias("_tick"))
    so_far = Window.partitionBy(*labels).orderBy("_tick").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counted, [*labels, "_tick"], "left").select(
        *labels,
        F.timestamp_micros(F.unix_micros(first) + F.col("_tick") * step).alias("ts"),
        F.coalesce(F.sum("_n").over(so_far), F.lit(0)).cast("double").alias("value"),
    )
