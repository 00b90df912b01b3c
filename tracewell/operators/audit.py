"""The audited run: attempts, status changes, lifecycle events, retries and tracing.

A *log* has one row per attempt; *changes* are the append-only rows it grows from, one per status change.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from threading import Thread
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tracewell.functions.text import message_or
from tracewell.operators.keyed import sole_by_key
from tracewell.scale import largest_group, running, spread_join

ATTEMPT_KEY = ["pipeline_name", "environment_name", "run_id", "attempt_number"]
RUN_KEY = ATTEMPT_KEY[:3]

# Event names, event messages, defaults, limits.
EVENT_OF_STATUS = {"SUCCESS": "SUCCEEDED", "FAILED": "FAILED"}
STARTED_MESSAGE = "Execution attempt started"
FAILED_MESSAGE = "Execution attempt failed"
DONE_MESSAGE = "Execution attempt completed successfully"
LOG_DEFAULTS = {"attempt_number": (1, "int"), "trigger_type": ("MANUAL", "string"), "correlation_id": (None, "string")}
MAX_RETRIES = 2
STALE_SECONDS = 1800

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("pipeline_name", T.StringType()),
        T.StructField("environment_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt_number", T.IntegerType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("trigger_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("records_read", T.LongType()),
        T.StructField("records_written", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def trigger_type(run_id: Column) -> Column:
    """Upper-cased text before the first double underscore, or AIRFLOW when there is none."""
    return F.when(run_id.contains("__"), F.upper(F.split(run_id, "__", 2)[0])).otherwise(F.lit("AIRFLOW"))


def run_identity(df: DataFrame, job_id: str | Column) -> DataFrame:
    """Add trigger type and correlation id, and put the environment in upper case."""
    job = F.lit(job_id) if isinstance(job_id, str) else job_id
    return df.withColumns(
        {
            "trigger_type": trigger_type(F.col("run_id")),
            "correlation_id": F.concat(job, F.lit(":"), F.col("run_id")),
            "environment_name": F.upper("environment_name"),
        }
    )


def evolve_log(df: DataFrame) -> DataFrame:
    """Add columns an older log lacks, and fill missing correlation ids with pipeline and run."""
    missing = {c: F.lit(v).cast(t) for c, (v, t) in LOG_DEFAULTS.items() if c not in df.columns}
    grown = df.withColumns(missing) if missing else df
    fallback = F.concat("pipeline_name", F.lit(":"), "run_id")
    return grown.withColumn("correlation_id", F.coalesce("correlation_id", fallback))


def start_attempts(requests: DataFrame, as_of: Column) -> DataFrame:
    """RUNNING rows to append to the log for the requested attempts."""
    return requests.withColumns(
        {
            "status": F.lit("RUNNING"),
            "started_at": as_of,
            "finished_at": F.lit(None).cast("timestamp"),
            "records_read": F.lit(0).cast("long"),
            "records_written": F.lit(0).cast("long"),
            "error_message": F.lit(None).cast("string"),
        }
    )


def finalize_attempts(log: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Write status, counts and message of matching attempts; unmatched outcomes are not inserted.

    The finish time is set only when the status changes into a final one. Two outcomes of one attempt are an error.
    """
    new = sole_by_key(outcomes, ATTEMPT_KEY, ["status", "records_read", "records_written", "error_message"])
    joined = spread_join(log, new, ATTEMPT_KEY, "left")
    hit = F.col("_new").isNotNull()
    closes = hit & F.col("_new.status").isin("SUCCESS", "FAILED") & ~F.col("_new.status").eqNullSafe(F.col("status"))
    changed = {
        c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
        for c in ("records_read", "records_written", "error_message")
    }
    return (
        joined.withColumn("finished_at", F.when(closes, as_of).otherwise(F.col("finished_at")))
        .withColumns({**changed, "status": F.when(hit, F.col("_new.status")).otherwise(F.col("status"))})
        .select(*log.columns)
    )


def event_metadata() -> Column:
    """JSON object that identifies the attempt of an event."""
    return F.to_json(
        F.struct(
            "pipeline_name", "environment_name", "run_id", "attempt_number", "correlation_id", "trigger_type"
        )
    )


def event_type(status: Column, is_insert: Column) -> Column:
    """STARTED for a new row, otherwise the event named by the status."""
    named = status
    for s, event in EVENT_OF_STATUS.items():
        named = F.when(status == s, F.lit(event)).otherwise(named)
    return F.when(is_insert, F.lit("STARTED")).otherwise(named)


def event_message(status: Column, is_insert: Column, error: Column) -> Column:
    return (
        F.when(is_insert, F.lit(STARTED_MESSAGE))
        .when(status == "FAILED", message_or(error, FAILED_MESSAGE))
        .otherwise(F.lit(DONE_MESSAGE))
    )


def lifecycle_events(
    changes: DataFrame, key: str = "execution_id", order: tuple[str, ...] = ("changed_at", "change_no"),
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Events from status changes: STARTED for an attempt's first row, then one for each changed status.

    ``sizes`` may hand over ``largest_group`` of the changes by their key.
    """
    seen = running(
        changes,
        [key],
        order,
        {"_previous": ("lag", "status"), "_nth": ("row_number",)},
        sizes=sizes,
    )
    first = F.col("_nth") == 1
    return (
        seen.where(first | ~F.col("status").eqNullSafe(F.col("_previous")))
        .withColumns(
            {
                "event_type": event_type(F.col("status"), first),
                "message": event_message(F.col("status"), first, F.col("error_message")),
                "metadata": event_metadata(),
            }
        )
        .select(key, "event_type", F.col(order[0]).alias("event_at"), *order[1:], "message", "metadata")
    )


def next_attempts(log: DataFrame, requests: DataFrame, order: list[str], max_retries: int = MAX_RETRIES) -> DataFrame:
    """Number requested attempts after the run's history; requests beyond the retry budget are refused.

    ``order`` orders the requests of one run totally. Adds ``attempt_number`` and ``accepted``.
    """
    last = log.groupBy(*RUN_KEY).agg(F.max("attempt_number").alias("_last"))
    ranked = running(requests, RUN_KEY, order, {"_nth": ("row_number",)})
    numbered = spread_join(ranked, last, RUN_KEY, "left").withColumn(
        "attempt_number", (F.coalesce(F.col("_last"), F.lit(0)) + F.col("_nth")).cast("long")
    )
    return numbered.withColumn("accepted", F.col("attempt_number") <= max_retries + 1).drop("_last", "_nth")


def retry_chain(log: DataFrame, order: tuple[str, ...] = ("attempt_number", "execution_id")) -> DataFrame:
    """Attempts of a correlation id in order, with the previous status and whether the attempt is the last one."""
    sizes = largest_group(log, ["correlation_id"])
    seen = running(
        log,
        ["correlation_id"],
        order,
        {"attempt_position": ("row_number",), "previous_status": ("lag", "status")},
        sizes=sizes,
    )
    final = log.groupBy("correlation_id").agg(
        F.max_by("status", F.struct(*order)).alias("final_status"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "FAILED").alias("failed_attempts"),
    )
    joined = spread_join(seen, final, ["correlation_id"], "left", sizes=sizes)
    return joined.withColumn("is_final", F.col("attempt_position") == F.col("attempts"))


def trace_rows(target: DataFrame, log: DataFrame, on: tuple[str, ...] = ("run_id", "attempt_number")) -> DataFrame:
    """Target rows with the attempt that wrote them; the log side may hold equal runs of several pipelines."""
    columns = ["execution_id", "pipeline_name", "environment_name", "status", "started_at", "finished_at"]
    wanted = [c for c in columns if c in log.columns and c not in on]
    return merge_on_shared(target, log.select(*on, *wanted), on)


def merge_on_shared(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Many-to-many equi join; adaptive execution splits a skewed side, as both are plain shuffles."""
    return left.join(right, list(on), "inner")


def run_events(events: DataFrame, log: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Events with the identity of their attempt.

    An attempt has no more events than changes, so ``largest_group`` of the changes may be handed over as ``sizes``.
    """
    identity = log.select("execution_id", *ATTEMPT_KEY, "correlation_id")
    return spread_join(events, identity, ["execution_id"], "inner", sizes=sizes)


def attempt_history(log: DataFrame, order: tuple[str, ...] = ("attempt_number", "execution_id"), page: int = 1000) -> DataFrame:
    """Per correlation id the text ``attempt:status:written:message`` of its attempts, in order."""
    entry = F.concat_ws(
        ":",
        F.col("attempt_number").cast("string"),
        "status",
        F.col("records_written").cast("string"),
        F.coalesce("error_message", F.lit("")),
    )
    return _joined_text(log.withColumn("_entry", entry), order, "attempt_history", page)


def event_sequence(
    events: DataFrame, order: tuple[str, ...] = ("event_at", "change_no"), page: int = 1000,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Per correlation id the event types in order; ``sizes`` may hand over a bound such as ``largest_group`` of the
    changes by correlation id, as a run has no more events than changes."""
    return _joined_text(events.withColumn("_entry", F.col("event_type")), order, "event_sequence", page, sizes)


def _joined_text(df: DataFrame, order: tuple[str, ...], out: str, page: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One text per correlation id, continued on further pages where a run has more entries than fit one."""
    entries = df.select("correlation_id", *order, "_entry")
    numbered = running(entries, ["correlation_id"], order, {"_nth": ("row_number",)}, sizes=sizes)
    entries = F.array_sort(F.collect_list(F.struct("_nth", "_entry")))
    return (
        numbered.groupBy("correlation_id", F.floor((F.col("_nth") - 1) / page).alias("page"))
        .agg(F.array_join(F.transform(entries, lambda e: e["_entry"]), ",").alias(out))
    )


def load_summary(target: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """Per run: rows, exact amount sum as a two-decimal text, and attempts that never finished."""
    loaded = target.groupBy(*on).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("amount").cast("decimal(38,2)").cast("string").alias("amount_sum"),
    )
    unfinished = log.groupBy(*on).agg(F.count_if(F.col("finished_at").isNull()).alias("unfinished"))
    return loaded.join(unfinished, on, "full").select(
        *on,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("amount_sum", F.lit("0.00")).alias("amount_sum"),
        F.coalesce("unfinished", F.lit(0)).alias("unfinished"),
    )


def recent_executions(log: DataFrame) -> DataFrame:
    """Newest first, with a full tie-break."""
    return log.select(
        "pipeline_name", "environment_name", "run_id", "attempt_number", "status",
        "records_written", "started_at", "finished_at", "execution_id",
    ).orderBy(F.desc("started_at"), *ATTEMPT_KEY, "execution_id")


def stale_running(log: DataFrame, as_of: Column, after_seconds: int = STALE_SECONDS) -> DataFrame:
    """Attempts RUNNING for strictly longer than the limit."""
    limit = as_of - F.make_dt_interval(secs=F.lit(after_seconds))
    return log.where((F.col("status") == "RUNNING") & (F.col("started_at") < limit))


def current_log(changes: DataFrame) -> DataFrame:
    """The log as it follows from appended changes: the start of each attempt and its latest state."""
    latest = F.struct("changed_at", F.col("status") != "RUNNING")
    rest = ["correlation_id", "trigger_type", "status", "records_read", "records_written", "error_message"]
    return (
        changes.groupBy(*ATTEMPT_KEY)
        .agg(
            F.min("changed_at").alias("started_at"),
            F.max(F.when(F.col("status").isin("SUCCESS", "FAILED"), F.col("changed_at"))).alias("_closed"),
            F.max_by(F.struct(*rest), latest).alias("_row"),
        )
        .select(
            *ATTEMPT_KEY,
            "_row.*",
            "started_at",
            F.when(F.col("_row.status") != "RUNNING", F.col("_closed")).alias("finished_at"),
        )
    )


def _observed(seen: Observation, patience: float) -> int:
    """Rows counted by an action that has ended; waiting in vain means that no action read them."""
    found: list[int] = []
    waiter = Thread(target=lambda: found.append(seen.get["rows"]), daemon=True)
    waiter.start()
    waiter.join(patience)
    if not found:
        raise RuntimeError("no action read the counted rows: write must run the job it is given")
    return found[0]


def audited_run(
    spark: SparkSession,
    identity: Mapping[str, Any],
    job: Callable[[Callable[[DataFrame], DataFrame]], DataFrame],
    write: Callable[[DataFrame], None],
    changes_path: str,
    patience: float = 60.0,
) -> dict[str, Any]:
    """Run ``job``, write its rows, and append the attempt's status changes to ``changes_path``.

    ``job`` gets a function that counts the rows of each input it is applied to; the counts add up. Counts come from
    the same pass as the data, so a ``write`` that runs no action fails after ``patience`` seconds without a count. A failure is recorded and raised again; when even that record fails, both errors are raised.
    """
    seen_in: list[Observation] = []
    seen_out = Observation("rows_out")

    def count_input(df: DataFrame) -> DataFrame:
        seen_in.append(Observation(f"rows_in_{len(seen_in)}"))
        return df.observe(seen_in[-1], F.count(F.lit(1)).alias("rows"))

    def record(status: str, read: int, written: int, message: str | None) -> None:
        row = [identity.get(f.name) for f in CHANGE_SCHEMA.fields[:6]]
        row += [status, datetime.now(timezone.utc), read, written, message]
        spark.createDataFrame([tuple(row)], CHANGE_SCHEMA).write.mode("append").parquet(changes_path)

    record("RUNNING", 0, 0, None)
    done, rows_in, rows_out = False, 0, 0
    try:
        write(job(count_input).observe(seen_out, F.count(F.lit(1)).alias("rows")))
        rows_out = _observed(seen_out, patience)
        rows_in = sum(_observed(o, patience) for o in seen_in) if seen_in else rows_out
        done = True
        record("SUCCESS", rows_in, rows_out, None)
    except Exception as failure:
        try:
            record("FAILED", rows_in if done else 0, rows_out if done else 0, str(failure)[:1000])
        except Exception as second:
            raise RuntimeError(f"run failed and its audit record could not be written: {second}") from failure
        raise
    return {**identity, "status": "SUCCESS", "records_read": rows_in, "records_written": rows_out}
