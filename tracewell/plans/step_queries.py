"""Queries for sources, sinks, the step vocabulary, numbering, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import numeric, text
from tracewell.operators import keyed, steps
from tracewell.plans.views import load
from tracewell.session import work_path
from tracewell.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


@query(
    """SELECT 'synthetic-retail' AS customer_segment, 'generic-crm' AS source_system,
 CAST(120.50 AS DECIMAL(12, 2)) AS amount, row_number() OVER (ORDER BY c_custkey) AS record_id FROM customer"""
)
def generate_rows(spark, sf):
    n = load(spark, sf, "customer").count()
    fields = {
        "customer_segment": ("synthetic-retail", "string"),
        "source_system": ("generic-crm", "string"),
        "amount": ("120.50", "decimal(12,2)"),
    }
    rows = tables.generate_rows(spark, n, fields).withColumn("_id", F.monotonically_increasing_id())
    return keyed.add_sequence(rows, ["_id"], "record_id").drop("_id")


@query(
    """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
 WHERE o_orderstatus = 'F' AND o_totalprice > 1000.0 GROUP BY o_orderpriority"""
)
def table_input(spark, sf):
    load(spark, sf, "orders")
    sql = (
        "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {source} "
        "WHERE o_orderstatus = :status AND o_totalprice > :low GROUP BY o_orderpriority"
    )
    return tables.table_input(spark, f"{sf}/orders.parquet", sql, {"status": "F", "low": 1000.0}, fmt="parquet")


@query("SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id FROM customer")
def table_output(spark, sf):
    path = work_path(spark, "table-output")
    mapping = {"c_custkey": "customer_id", "c_name": "customer_name", "c_nationkey": "nation_id"}
    tables.table_output(load(spark, sf, "customer"), path, mapping)
    return spark.read.parquet(path)


@query(
    """SELECT c.c_custkey, c.c_name, coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
 round(coalesce(u.c_acctbal, c.c_acctbal), 2) AS c_acctbal
 FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS c_mktsegment,
 arg_max(o_totalprice, o_orderkey) AS c_acctbal FROM orders GROUP BY o_custkey) u ON c.c_custkey = u.o_custkey"""
)
def update_by_key(spark, sf):
    customer = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    updates = load(spark, sf, "orders").selectExpr(
        "o_custkey AS c_custkey", "o_orderpriority AS c_mktsegment", "o_totalprice AS c_acctbal", "o_orderkey"
    )
    out = tables.update_by_key(customer, updates, ["c_custkey"], ["c_mktsegment", "c_acctbal"], ["o_orderkey"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'not JSON' WHEN p_partkey % 50 = 9
 THEN 'no array named components' END AS error, CASE WHEN p_partkey % 50 NOT IN (7, 9) THEN i END AS position,
 CASE WHEN p_partkey % 50 NOT IN (7, 9) THEN concat(CASE i WHEN 0 THEN 'base ' ELSE 'add ' END, p_name) END AS name,
 CASE WHEN p_partkey % 50 NOT IN (7, 9) AND i = 0 THEN CAST(p_size AS VARCHAR) END AS version
 FROM part CROSS JOIN (VALUES (0), (1)) v(i) WHERE p_partkey % 50 NOT IN (7, 9) OR i = 0"""
)
def read_json_records(spark, sf):
    docs = load(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE WHEN p_partkey % 50 = 7 THEN concat('{"components": [', p_name)
           WHEN p_partkey % 50 = 9 THEN concat('{"components": "', p_name, '"}')
           ELSE concat('{"components": [{"name": "base ', p_name, '", "version": "', p_size,
                       '"}, {"name": "add ', p_name, '"}]}') END AS doc""",
    )
    return tables.json_records(docs, "doc", "components", "name STRING, version STRING")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000.0")
def filter_rows(spark, sf):
    ready = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 200000.0)
    return steps.filter_rows(load(spark, sf, "orders"), ready).select("o_orderkey", "o_totalprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net_amount,
 upper(l_returnflag) || l_linestatus AS flags FROM lineitem"""
)
def calculate(spark, sf):
    exprs = {
        "net_amount": "round(l_extendedprice * (1 - l_discount), 4)",
        "flags": F.concat(F.upper("l_returnflag"), "l_linestatus"),
    }
    out = steps.calculate(load(spark, sf, "lineitem"), exprs)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net_amount", "flags")


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_id, p_name AS title, CAST(p_size AS BIGINT) AS size FROM part")
def select_values(spark, sf):
    spec = {"p_partkey": ("part_id", "string"), "p_name": ("title", None), "p_size": ("size", "bigint")}
    return steps.select_values(load(spark, sf, "part"), spec)


@query(
    """SELECT c_custkey, 'PROD' AS environment_name, 'run-7' AS run_id, 3 AS attempt_number,
 'nightly:run-7' AS correlation_id, '${UNKNOWN}' AS kept FROM customer"""
)
def resolve_parameters(spark, sf):
    fields = {
        "environment_name": ("${RUN_ENV}", "string"),
        "run_id": ("${RUN_ID}", "string"),
        "attempt_number": ("${ATTEMPT_NUMBER}", "int"),
        "correlation_id": ("${JOB}:${RUN_ID}", "string"),
        "kept": ("${UNKNOWN}", "string"),
    }
    declared = {"RUN_ENV": "DEV", "RUN_ID": "local", "ATTEMPT_NUMBER": "1", "JOB": "nightly"}
    run = {"RUN_ENV": "PROD", "RUN_ID": "run-7", "ATTEMPT_NUMBER": 3}
    return steps.resolve_parameters(load(spark, sf, "customer").select("c_custkey"), fields, declared, run)


@query("SELECT o_orderkey, concat('/data/', o_orderpriority, '/', o_custkey, '/${DAY}') AS path FROM orders")
def expand_template(spark, sf):
    orders = load(spark, sf, "orders").withColumn(
        "params",
        F.create_map(F.lit("AREA"), "o_orderpriority", F.lit("CUSTOMER"), F.col("o_custkey").cast("string")),
    )
    template = F.lit("/data/${AREA}/${CUSTOMER}/${DAY}")
    return orders.select("o_orderkey", text.expand_template(template, F.col("params")).alias("path"))


@query(
    """SELECT c_custkey, c_name, coalesce(n.n_name, 'unknown') AS n_name, n.n_regionkey FROM customer c
 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 20"""
)
def lookup(spark, sf):
    nation = load(spark, sf, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    out = keyed.lookup(customer, nation, ["c_nationkey"], {"n_name": "unknown", "n_regionkey": None}, ["n_name"])
    return out.select("c_custkey", "c_name", "n_name", "n_regionkey")


@query(
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, o_orderkey FROM customer
 FULL JOIN orders ON c_custkey = o_custkey"""
)
def merge_join(spark, sf):
    customer = load(spark, sf, "customer").selectExpr("c_custkey AS custkey", "c_name")
    orders = load(spark, sf, "orders").selectExpr("o_custkey AS custkey", "o_orderkey")
    return steps.merge_join(customer, orders, ["custkey"], "full")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate FROM lineitem JOIN orders
 ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate AND l_extendedprice < o_totalprice / 4"""
)
def join_rows(spark, sf):
    items = load(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = load(spark, sf, "orders")
    early = (F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("l_extendedprice") < F.col("o_totalprice") / 4)
    return steps.join_rows(items, orders, ["o_orderkey"], early).select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate"
    )


@query(
    """SELECT o.o_orderkey AS order_id, c.c_mktsegment AS segment FROM orders o JOIN customer c
 ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'"""
)
def orders_customer_sql(spark, sf):
    sql = (
        "SELECT o.o_orderkey AS order_id, c.c_mktsegment AS segment FROM {orders} o JOIN {customer} c "
        "ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = :status"
    )
    return spark.sql(
        sql, args={"status": "F"}, orders=load(spark, sf, "orders"), customer=load(spark, sf, "customer")
    )


@query(
    """SELECT c_mktsegment, c_nationkey, count(*) AS customers, round(avg(c_acctbal), 6) AS mean_balance,
 max(c_acctbal) AS top_balance FROM customer GROUP BY c_mktsegment, c_nationkey"""
)
def group_by(spark, sf):
    aggs = {
        "customers": F.count(F.lit(1)),
        "mean_balance": F.round(F.avg("c_acctbal"), 6),
        "top_balance": F.max("c_acctbal"),
    }
    return steps.group_by(load(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], aggs)


@query("SELECT c_custkey, 10 + 5 * (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS seq FROM customer")
def add_sequence(spark, sf):
    customer = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return keyed.add_sequence(customer, ["c_acctbal", "c_custkey"], start=10, step=5).select("c_custkey", "seq")


@query(
    """SELECT o_custkey AS artifact_id, o_orderkey, 'ev-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS id FROM orders"""
)
def assign_ordinals(spark, sf):
    orders = load(spark, sf, "orders").selectExpr("o_custkey AS artifact_id", "o_orderkey", "o_orderdate")
    return keyed.assign_ordinals(orders, "ev", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    """SELECT l_suppkey, arg_min(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_partkey,
 arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_orderkey FROM lineitem GROUP BY l_suppkey"""
)
def dedupe_first(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    items = load(spark, sf, "lineitem").select("l_suppkey", *order)
    return keyed.dedupe_first(items, ["l_suppkey"], order).select("l_suppkey", "l_partkey", "l_orderkey")


@query(
    """SELECT l_suppkey, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_partkey,
 arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_orderkey FROM lineitem GROUP BY l_suppkey"""
)
def dedupe_last(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    items = load(spark, sf, "lineitem").select("l_suppkey", *order)
    return keyed.dedupe_last(items, ["l_suppkey"], order).select("l_suppkey", "l_partkey", "l_orderkey")


CUT = "1998-06-01"


@query(
    f"""SELECT coalesce(b.k, a.k) AS component, b.v AS before, a.v AS after
 FROM (SELECT CAST(l_partkey AS VARCHAR) AS k, CAST(max(l_suppkey) AS VARCHAR) AS v FROM lineitem
       WHERE l_shipdate < DATE '{CUT}' GROUP BY l_partkey) b
 FULL JOIN (SELECT CAST(l_partkey AS VARCHAR) AS k, CAST(max(l_suppkey) AS VARCHAR) AS v FROM lineitem
       WHERE l_shipdate >= DATE '{CUT}' GROUP BY l_partkey) a ON b.k = a.k
 WHERE b.v IS DISTINCT FROM a.v"""
)
def snapshot_diff(spark, sf):
    items = load(spark, sf, "lineitem").selectExpr(
        "CAST(l_partkey AS STRING) AS name", "CAST(l_suppkey AS STRING) AS version", "l_suppkey", "l_shipdate"
    )
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return keyed.snapshot_diff(items.where(early), items.where(~early), "name", "version", order=["l_suppkey"])


@query(
    """SELECT DISTINCT l_orderkey AS case_id, concat('ev-', l_partkey % 40) AS ref FROM lineitem
 EXCEPT SELECT o_orderkey, concat('ev-', i) FROM orders CROSS JOIN generate_series(0, 29) g(i) WHERE i <= o_custkey % 30"""
)
def unknown_refs(spark, sf):
    claims = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS case_id", "array(concat('ev-', l_partkey % 40)) AS refs"
    )
    allowed = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS case_id", "explode(transform(sequence(0L, o_custkey % 30), i -> concat('ev-', i))) AS ref"
    )
    return keyed.unknown_refs(claims, allowed)


@query(
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_linenumber = 7)"
)
def missing_required(spark, sf):
    present = load(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7")
    present = present.selectExpr("l_partkey AS p_partkey")
    return keyed.missing_required(load(spark, sf, "part"), present, ["p_partkey"])


SET_SQL = """a AS (SELECT DISTINCT l_suppkey, l_partkey % 100 AS bucket FROM lineitem WHERE l_returnflag = 'A'),
 b AS (SELECT DISTINCT l_suppkey, l_partkey % 100 AS bucket FROM lineitem WHERE l_returnflag = 'R')"""


def _sides(spark, sf):
    items = load(spark, sf, "lineitem").selectExpr("l_suppkey", "l_partkey % 100 AS bucket", "l_returnflag")
    return [items.where(F.col("l_returnflag") == f).select("l_suppkey", "bucket") for f in ("A", "R")]


@query(
    f"""WITH {SET_SQL} SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
 UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
 UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def set_compare(spark, sf):
    return keyed.set_compare(*_sides(spark, sf), ["l_suppkey", "bucket"])


@query(f"WITH {SET_SQL} SELECT * FROM a UNION SELECT * FROM b")
def union_keys(spark, sf):
    return keyed.union_keys(*_sides(spark, sf))


@query(
    f"""WITH {SET_SQL} SELECT a.l_suppkey, count(*) FILTER (WHERE b.bucket IS NULL) AS missing,
 count(*) FILTER (WHERE b.bucket IS NULL) = 0 AS is_subset FROM a LEFT JOIN b USING (l_suppkey, bucket) GROUP BY a.l_suppkey"""
)
def is_subset(spark, sf):
    return keyed.is_subset(*_sides(spark, sf), ["l_suppkey"], ["bucket"])


@query(
    """WITH n AS (SELECT l_suppkey, l_partkey % 10 AS bucket, count(*) FILTER (WHERE l_returnflag = 'A') AS na,
 count(*) FILTER (WHERE l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
 SELECT l_suppkey, count(*) FILTER (WHERE na <> nb) AS differing, count(*) FILTER (WHERE na <> nb) = 0 AS same_multiset
 FROM n GROUP BY l_suppkey"""
)
def same_multiset(spark, sf):
    items = load(spark, sf, "lineitem").selectExpr("l_suppkey", "l_partkey % 10 AS bucket", "l_returnflag")
    a, b = (items.where(F.col("l_returnflag") == f) for f in ("A", "R"))
    return keyed.same_multiset(a, b, ["l_suppkey"], ["bucket"])


@query(
    r"""SELECT doc_id, regexp_replace(text, '''[^'']*(?:''''[^'']*)*''', '''[REDACTED_LITERAL]''', 'g') AS redacted
 FROM documents"""
)
def redact_sql_literals(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.redact_sql_literals(F.col("text")).alias("redacted"))


@query(
    r"""SELECT event_id, event_type, '[REDACTED]' AS api_key, '{"auth":{"Password":"[REDACTED]","user":' || user_id
 || '},"list":[{"token":"[REDACTED]","k":' || json_extract_string(props, '$.k') || '}]}' AS nested FROM events"""
)
def redact_keys(spark, sf):
    events = load(spark, sf, "events").selectExpr(
        "event_id", "event_type", "concat('key-', user_id) AS api_key",
        """named_struct('auth', named_struct('Password', concat('p', user_id), 'user', user_id),
           'list', array(named_struct('token', array(user_id), 'k', CAST(get_json_object(props, '$.k') AS BIGINT)))) AS nested""",
    )
    return text.redact_keys(events).withColumn("nested", F.to_json("nested"))


@query(
    """SELECT event_id, '{"user": ' || user_id || ', "Secret_Box": "[REDACTED]", "rows": [{"my-api-key": "[REDACTED]", "k": '
 || json_extract_string(props, '$.k') || '}]}' AS redacted FROM events"""
)
def redact_keys_json(spark, sf):
    doc = """concat('{"user": ', user_id, ', "Secret_Box": {"a": [1, ', user_id, ']}, "rows": [{"my-api-key": "x',
             user_id, '", "k": ', get_json_object(props, '$.k'), '}]}')"""
    events = load(spark, sf, "events").selectExpr("event_id", f"{doc} AS doc")
    return events.select("event_id", text.redact_keys_json("doc").alias("redacted"))


@query(
    r"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{0b}\p{Z}]+', ' ', 'g')))) AS digest
 FROM documents"""
)
def sql_digest(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.sql_digest(F.col("text")).alias("digest"))


@query(
    """SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM conversations"""
)
def strip_code_fence(spark, sf):
    wrapped = F.when(
        (F.col("conv_id") + F.col("turn")) % 2 == 0, F.concat(F.lit("\n```json\n"), "text", F.lit("\n```  "))
    ).otherwise(F.col("text"))
    turns = load(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.strip_code_fence(wrapped).alias("body"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' ELSE 'raw' END AS decoded_as,
 CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'OK' END AS result,
 CASE event_id % 3 WHEN 1 THEN event_type END AS message,
 CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) END AS id,
 CASE event_id % 3 WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN '<r><result>OK</r>' || user_id ELSE event_type || ' ' || user_id END END AS raw
 FROM events"""
)
def decode_responses(spark, sf):
    events = load(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 3 WHEN 0 THEN concat('{"result": "', event_type, '", "id": ', user_id, '}')
           WHEN 1 THEN concat('<webresult><result>OK</result><message>', event_type, '</message></webresult>')
           ELSE CASE WHEN event_id % 2 = 0 THEN concat('<r><result>OK</r>', user_id)
                ELSE concat(event_type, ' ', user_id) END END AS body""",
    )
    return text.decode_responses(events, "body").drop("body")


@query(
    """SELECT p_partkey, concat_ws('.', nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''),
 nullif(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, '')) AS name FROM part"""
)
def qualified_name(spark, sf):
    part = load(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS s", "CASE WHEN p_size % 5 <> 0 THEN p_type END AS t"
    )
    return part.select("p_partkey", text.qualified_name(F.col("s"), F.col("t")).alias("name"))


@query(
    """SELECT doc_id, left(text, 1000) AS summary, CASE WHEN doc_id % 4 = 0 THEN 'Execution attempt failed' ELSE left(text, 1000) END
 AS message FROM documents"""
)
def error_summary(spark, sf):
    short = text.error_summary(F.col("text"))
    blank = F.when(F.col("doc_id") % 4 == 0, "").otherwise(short)
    return load(spark, sf, "documents").select(
        "doc_id", short.alias("summary"), text.message_or(blank, "Execution attempt failed").alias("message")
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(epoch(l_shipdate) AS DOUBLE) AS ship_seconds,
 CAST(epoch(l_shipdate) - epoch(o_orderdate) AS DOUBLE) AS wait_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def epoch_seconds(spark, sf):
    items = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numeric.epoch_seconds(F.col("l_shipdate")).alias("ship_seconds"),
        numeric.duration_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("wait_seconds"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS refs FROM
 (SELECT *, 'ev-' || l_linenumber AS a, 'ev-' || (l_suppkey % 5) AS b FROM lineitem)"""
)
def uniq_refs(spark, sf):
    refs = F.expr("array(concat('ev-', l_linenumber), '', concat('ev-', l_suppkey % 5), NULL, concat('ev-', l_linenumber))")
    items = load(spark, sf, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(text.uniq_refs(refs), ",").alias("refs")
    )


@query(
    """SELECT n.c_mktsegment, greatest(n.low, 0) AS low, round(n.rich / greatest(n.n, 1), 6) AS ratio FROM (SELECT c_mktsegment,
 min(c_acctbal) AS low, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 5000) AS rich FROM customer GROUP BY 1) n"""
)
def safe_ratio(spark, sf):
    per = load(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.min("c_acctbal").alias("low"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("c_acctbal") > 5000).alias("rich"),
    )
    return per.select(
        "c_mktsegment",
        numeric.clamp_min(F.col("low"), 0.0).alias("low"),
        F.round(numeric.safe_ratio(F.col("rich"), F.col("n")), 6).alias("ratio"),
    )


PART_JSON = """'{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'"""


NESTED_JSON = """'{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || ',"traits":[{"key":"brand","value":{"code":"' || p_brand
 || '","size":' || p_size || '}},{"key":"kind","value":{"code":"' || p_type || '","size":null}}]}'"""


@query(f"SELECT p_partkey, sha256({NESTED_JSON}) AS digest FROM part")
def record_digest(spark, sf):
    """Digests of nested rows; the map is filled in another order on every second row."""
    entries = ["'brand', named_struct('size', p_size, 'code', p_brand)", "'kind', named_struct('size', CAST(NULL AS INT), 'code', p_type)"]
    maps = [f"map({', '.join(e)})" for e in (entries, entries[::-1])]
    parts = load(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("int"))
    parts = parts.selectExpr("p_partkey", "p_name", "p_size", f"CASE WHEN p_partkey % 2 = 0 THEN {maps[0]} ELSE {maps[1]} END AS traits")
    digest = text.record_digest(["p_partkey", "p_name", "p_size", "traits"], parts.schema)
    return parts.select("p_partkey", digest.alias("digest"))


@query(f"SELECT {PART_JSON} AS value FROM part")
def write_report(spark, sf):
    path = work_path(spark, "report")
    tables.write_report(load(spark, sf, "part").select("p_size", "p_partkey", "p_name"), path)
    return spark.read.text(path)
