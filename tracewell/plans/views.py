"""Log, change, target and sample views over the test tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = "1998-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


RUN_ID = (
    "CASE o_custkey % 4 WHEN 0 THEN concat('scheduled__', o_orderkey) WHEN 1 THEN concat('manual__', o_orderkey) "
    "WHEN 2 THEN concat('backfill__re__', o_orderkey) ELSE concat('', o_orderkey) END"
)
ENVIRONMENT = "CASE o_custkey % 3 WHEN 0 THEN 'DEV' WHEN 1 THEN 'TEST' ELSE 'PROD' END"
TRIGGER = "CASE o_custkey % 4 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'BACKFILL' ELSE 'AIRFLOW' END"


def _log_columns(minutes: str) -> list[str]:
    return [
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
        "CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS execution_id",
        "o_orderpriority AS pipeline_name",
        f"{ENVIRONMENT} AS environment_name",
        f"{RUN_ID} AS run_id",
        "l_linenumber AS attempt_number",
        "CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' ELSE 'RUNNING' END AS status",
        "CAST(l_shipdate AS TIMESTAMP) AS started_at",
        f"CAST(CASE WHEN l_returnflag <> 'N' THEN l_shipdate + {minutes} END AS TIMESTAMP) AS finished_at",
        "CAST(l_quantity AS BIGINT) AS records_read",
        "CASE WHEN l_returnflag = 'R' THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS records_written",
        "CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 5 = 0 THEN '' "
        "ELSE concat('failed on part ', l_partkey) END END AS error_message",
        f"concat(o_orderpriority, ':', {RUN_ID}) AS correlation_id",
        f"{TRIGGER} AS trigger_type",
        "l_suppkey AS supplier",
    ]


def exec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per line item: the order is the run, the line number the attempt."""
    items = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders")
    minutes = "make_dt_interval(0, 0, CAST(l_quantity AS INT), 0)"
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_log_columns(minutes))


LOG_SQL = (
    "exec_log AS (SELECT "
    + ", ".join(_log_columns("to_minutes(CAST(l_quantity AS BIGINT))"))
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def exec_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: start and end of each attempt, some inserted as final, some reopened."""
    log = exec_log(spark, sf_dir)
    closed = F.col("status") != "RUNNING"
    running_row = F.struct(
        F.lit(0).alias("change_no"), F.lit("RUNNING").alias("status"), F.col("started_at").alias("changed_at")
    )
    final_row = F.struct(F.lit(1).alias("change_no"), F.col("status"), F.col("finished_at").alias("changed_at"))
    reopened = F.struct(
        F.lit(2).alias("change_no"),
        F.lit("RUNNING").alias("status"),
        (F.col("finished_at") + F.expr("INTERVAL 1 MINUTE")).alias("changed_at"),
    )
    rows = F.array_compact(
        F.array(
            F.when(~closed | (F.col("supplier") % 10 != 3), running_row),
            F.when(closed, final_row),
            F.when(closed & (F.col("supplier") % 10 == 4), reopened),
        )
    )
    kept = [c for c in log.columns if c not in ("status", "started_at", "finished_at")]
    return log.select(*kept, F.explode(rows).alias("_c")).select(*kept, "_c.*")


_CHANGE_REST = (
    "execution_id, pipeline_name, environment_name, run_id, attempt_number, records_read, records_written, "
    "error_message, correlation_id, trigger_type, supplier"
)
CHANGES_SQL = f"""exec_changes AS (
SELECT {_CHANGE_REST}, 0 AS change_no, 'RUNNING' AS status, started_at AS changed_at FROM exec_log
 WHERE status = 'RUNNING' OR supplier % 10 <> 3
UNION ALL SELECT {_CHANGE_REST}, 1, status, finished_at FROM exec_log WHERE status <> 'RUNNING'
UNION ALL SELECT {_CHANGE_REST}, 2, 'RUNNING', finished_at + INTERVAL 1 MINUTE FROM exec_log
 WHERE status <> 'RUNNING' AND supplier % 10 = 4)"""


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded records: events, written by the run whose order number is the user."""
    events = load(spark, sf_dir, "events")
    orders = load(spark, sf_dir, "orders")
    return events.join(orders, F.col("user_id") == F.col("o_orderkey")).selectExpr(
        f"{RUN_ID} AS run_id",
        "CAST(event_id % 4 + 1 AS INT) AS attempt_number",
        "event_id AS record_id",
        "event_type AS customer_segment",
        "CAST(value AS DECIMAL(12, 2)) AS amount",
    )


TARGET_SQL = f"""target_rows AS (SELECT {RUN_ID} AS run_id, CAST(event_id % 4 + 1 AS INT) AS attempt_number,
 event_id AS record_id, event_type AS customer_segment, CAST(value AS DECIMAL(12, 2)) AS amount
 FROM events JOIN orders ON user_id = o_orderkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: one series per user, no value where an error was logged."""
    return load(spark, sf_dir, "events").selectExpr(
        "user_id AS series",
        "CAST(ts AS TIMESTAMP) AS ts",
        "CASE WHEN event_type <> 'error' THEN value END AS value",
    )


SAMPLES_SQL = """samples AS (SELECT user_id AS series, ts,
 CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
