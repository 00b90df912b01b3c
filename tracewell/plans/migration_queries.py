"""Queries for migration plans, validation, reconciliation and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tracewell.operators import migration, quality
from tracewell.operators.audit import ATTEMPT_KEY
from tracewell.plans.corpus import ITEMS_SQL, stored_tables
from tracewell.plans.views import LOG_SQL, exec_log, load, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


MAP_SQL = f"mapping(t, hop_target, disposition) AS (VALUES {_values((k, *v) for k, v in migration.COMPONENTS.items())})"


@query(
    with_sql(ITEMS_SQL, MAP_SQL)
    + """SELECT artifact_id, step_id, name AS legacy_name, type AS legacy_type, coalesce(hop_target, 'No automatic mapping') AS hop_target,
 coalesce(disposition, 'manual-required') AS disposition FROM items LEFT JOIN mapping ON t = lower(type) WHERE kind = 'step'"""
)
def plan_components(spark, sf):
    return migration.plan_components(stored_tables(spark, sf)["steps"]).drop("evidence_refs")


DIGEST_SQL = r"sha256(lower(trim(regexp_replace(value, '\s+', ' ', 'g'))))"


@query(
    with_sql(ITEMS_SQL)
    + f"""SELECT artifact_id, CASE kind WHEN 'connection' THEN 'connection_strategy' WHEN 'parameter' THEN 'parameter_strategy'
 ELSE 'variable_strategy' END AS section, name AS item, CASE kind WHEN 'connection' THEN '{migration.ACTIONS["connections"]}'
 WHEN 'parameter' THEN '{migration.ACTIONS["parameters"]}' ELSE '{migration.ACTIONS["variables"]}' END AS detail, evidence_id AS evidence_refs
 FROM items WHERE kind IN ('connection', 'parameter', 'variable')
 UNION ALL SELECT artifact_id, 'workflow_dependencies', from_name, to_name, evidence_id FROM items WHERE kind = 'pipeline_dependency'
 UNION ALL SELECT artifact_id, 'sql_strategy', sql_id, {DIGEST_SQL}, evidence_id FROM items WHERE kind = 'sql'"""
)
def migration_plan(spark, sf):
    plan = migration.migration_plan(stored_tables(spark, sf))
    picked = {
        "connection_strategy": ("name", "action"), "parameter_strategy": ("name", "action"),
        "variable_strategy": ("name", "action"), "workflow_dependencies": ("from_name", "to_name"),
        "sql_strategy": ("sql_id", "source_digest"),
    }
    parts = [
        plan[s].select(
            "artifact_id", F.lit(s).alias("section"), F.col(a).alias("item"), F.col(b).alias("detail"),
            F.array_join("evidence_refs", ",").alias("evidence_refs"),
        )
        for s, (a, b) in picked.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _migrated(tables):
    """A target estate made from the corpus: some runs lose parameters, steps, tables or change their SQL."""
    number = F.regexp_extract("artifact_id", r"a(\d+)\.", 1).cast("long")
    changed = dict(tables)
    changed["parameters"] = tables["parameters"].where(number % 3 != 1)
    changed["steps"] = tables["steps"].where((number % 5 != 2) | (F.col("name") != "Sort By Meter"))
    renamed = F.when((number % 7 == 3) & (F.col("direction") == "target"), F.concat("name", F.lit("_v2"))).otherwise(F.col("name"))
    changed["endpoints"] = tables["endpoints"].withColumn("name", renamed)
    other = F.when(number % 11 == 4, F.concat("statement", F.lit(" AND 1 = 1"))).otherwise(F.concat(F.lit("\n "), F.upper("statement")))
    changed["sql_statements"] = tables["sql_statements"].withColumn("statement", other)
    return changed


CHECKS_SQL = rf"""facts AS (
 SELECT artifact_id, 'legacy' AS side, kind, role, name, value FROM items
 UNION ALL SELECT artifact_id, 'target', kind, role, CASE WHEN kind = 'table' AND role = 'target' AND k % 7 = 3 THEN name || '_v2' ELSE name END,
 CASE WHEN kind <> 'sql' THEN value WHEN k % 11 = 4 THEN value || ' AND 1 = 1' ELSE value END
 FROM items WHERE NOT (kind = 'parameter' AND k % 3 = 1) AND NOT (kind = 'step' AND k % 5 = 2 AND name = 'Sort By Meter')),
ends AS (SELECT artifact_id, position FROM items WHERE is_endpoint),
listed AS (
 SELECT artifact_id, side, 'source tables preserved' AS chk, list_sort(list(DISTINCT name)) AS v FROM facts WHERE kind = 'table' AND role = 'source' GROUP BY 1, 2
 UNION ALL SELECT artifact_id, side, 'target tables preserved', list_sort(list(DISTINCT name)) FROM facts WHERE kind = 'table' AND role = 'target' GROUP BY 1, 2
 UNION ALL SELECT artifact_id, side, 'parameters preserved', list_sort(list(name)) FROM facts WHERE kind = 'parameter' GROUP BY 1, 2
 UNION ALL SELECT artifact_id, side, 'variables preserved', list_sort(list(name)) FROM facts WHERE kind = 'variable' GROUP BY 1, 2
 UNION ALL SELECT artifact_id, side, 'SQL digest preserved', list_sort(list({DIGEST_SQL})) FROM facts WHERE kind = 'sql' GROUP BY 1, 2
 UNION ALL SELECT artifact_id, side, 'named transformation steps preserved', list_sort(list(DISTINCT name)) FROM facts WHERE kind = 'step' AND name <> '' GROUP BY 1, 2),
checks AS (SELECT p.artifact_id, c.chk, c.how, c.severity, coalesce(a.v, []) AS expected, coalesce(b.v, []) AS actual
 FROM (SELECT DISTINCT artifact_id FROM items) p
 CROSS JOIN (VALUES {_values((c, *v) for c, v in migration.CHECKS.items())}) c(chk, how, severity)
 LEFT JOIN listed a ON a.artifact_id = p.artifact_id AND a.chk = c.chk AND a.side = 'legacy'
 LEFT JOIN listed b ON b.artifact_id = p.artifact_id AND b.chk = c.chk AND b.side = 'target'),
judged AS (SELECT *, CASE how WHEN 'same' THEN expected = actual ELSE list_has_all(actual, expected) END AS passed FROM checks)"""


def _checked(spark, sf):
    tables = stored_tables(spark, sf)
    pairs = tables["pipelines"].select(F.col("artifact_id").alias("legacy_id"), F.col("artifact_id").alias("target_id"))
    return migration.validate_migration(tables, _migrated(tables), pairs)


@query(
    with_sql(ITEMS_SQL, CHECKS_SQL)
    + """SELECT artifact_id AS legacy_id, chk AS "check", passed, severity, array_to_string(expected, '|') AS expected,
 array_to_string(actual, '|') AS actual FROM judged"""
)
def validate_migration(spark, sf):
    joined = {c: F.array_join(c, "|") for c in ("expected", "actual")}
    return _checked(spark, sf).withColumns(joined).drop("target_id")


@query(
    with_sql(ITEMS_SQL, CHECKS_SQL)
    + """SELECT artifact_id AS legacy_id, CASE WHEN count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 THEN 'PASS' ELSE 'FAIL' END
 AS status, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS error_count,
 count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warning_count FROM judged GROUP BY 1"""
)
def migration_status(spark, sf):
    return migration.migration_status(_checked(spark, sf)).drop("target_id")


COPY_SQL = """copy AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 <> 3 THEN o_totalprice END AS o_totalprice, o_orderpriority
 FROM orders WHERE o_orderkey % 100 <> 7
 UNION ALL SELECT -1 - o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 1000 = 9)"""


def _copy(orders):
    price = F.when(F.col("o_orderkey") % 50 != 3, F.col("o_totalprice")).alias("o_totalprice")
    kept = orders.where("o_orderkey % 100 <> 7").select("o_orderkey", "o_custkey", price, "o_orderpriority")
    added = orders.where("o_orderkey % 1000 = 9").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return kept.unionByName(added.select(kept.columns))


RECONCILE_FACTS = [("rows", "count(*)")]
RECONCILE_FACTS += [(f"nulls {c}", f"count(*) - count({c})") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")]
RECONCILE_FACTS += [("sum o_totalprice", "sum(CAST(o_totalprice AS DECIMAL(28, 6)))")]


@query(
    with_sql(COPY_SQL)
    + " UNION ALL ".join(
        f"SELECT '{name}' AS fact, CAST((SELECT {e} FROM orders) AS DOUBLE) AS source, CAST((SELECT {e} FROM copy) AS DOUBLE) AS target, "
        f"(SELECT {e} FROM orders) = (SELECT {e} FROM copy) AS agrees"
        for name, e in RECONCILE_FACTS
    )
    + """ UNION ALL SELECT 'keys only here', CAST(a AS DOUBLE), CAST(b AS DOUBLE), a = 0 AND b = 0 FROM (SELECT
 (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM copy)) AS a,
 (SELECT count(*) FROM copy WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS b)"""
)
def reconcile(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    facts = migration.reconcile(orders, _copy(orders), ["o_orderkey"], ["o_totalprice"])
    return facts.withColumns({c: F.col(c).cast("double") for c in ("source", "target")})


ROW_SQL = "sha256({})".format(
    " || ".join(f"'=' || length(CAST({c} AS VARCHAR)) || ':' || {c}" for c in ("o_custkey", "o_orderkey", "{status}"))
)


def _digest_sql(status: str = "o_orderstatus") -> str:
    row = ROW_SQL.format(status=status)
    sums = [f"CAST(sum(CAST(CAST('0x' || substr({row}, {at}, 15) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR)" for at in (1, 16)]
    return f"count(*) || '-' || {sums[0]} || '-' || {sums[1]}"


@query(f"SELECT o_orderpriority, {_digest_sql()} AS digest FROM orders GROUP BY 1")
def dataset_digest(spark, sf):
    return migration.dataset_digest(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query(
    """SELECT o_orderpriority AS dataset, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS missing_stages,
 CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN 'FAIL' ELSE 'PASS' END AS status FROM orders GROUP BY o_orderpriority"""
)
def promotion_parity(spark, sf):
    orders = load(spark, sf, "orders").withColumnRenamed("o_orderpriority", "dataset")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    changed = F.when((F.col("dataset") == "2-HIGH") & (F.col("o_orderkey") % 10 == 1), "X").otherwise(F.col("o_orderstatus"))
    stages = {
        "dev": orders,
        "test": orders.repartition(7, "o_custkey"),
        "prod": orders.where("dataset <> '5-LOW'").withColumn("o_orderstatus", changed),
    }
    digests = [migration.dataset_digest(d, columns, ["dataset"]).withColumn("stage", F.lit(s)) for s, d in stages.items()]
    return migration.promotion_parity(reduce(DataFrame.unionByName, digests), list(stages))


@query(
    """SELECT coalesce(a.m, b.m) AS metric, a.v AS current, b.v AS baseline, coalesce(abs(a.v - b.v) <= 60.0, false) AS holds
 FROM (SELECT c_mktsegment AS m, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) a
 FULL JOIN (SELECT c_mktsegment AS m, CAST(count(*) FILTER (WHERE c_acctbal > 0 OR c_nationkey > 12) AS DOUBLE) AS v FROM customer GROUP BY 1) b ON a.m = b.m"""
)
def compare_baseline(spark, sf):
    customer = load(spark, sf, "customer")
    current = customer.where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("value"))
    good = F.count_if((F.col("c_acctbal") > 0) | (F.col("c_nationkey") > 12)).cast("double").alias("value")
    baseline = customer.groupBy("c_mktsegment").agg(good)
    named = [d.withColumnRenamed("c_mktsegment", "metric") for d in (current, baseline)]
    return migration.compare_baseline(*named, tolerance=60.0)


@query(
    with_sql(LOG_SQL)
    + """SELECT 'allowed' AS rule, 'status' AS "column", execution_id AS row_key, status AS value FROM exec_log WHERE status NOT IN ('SUCCESS', 'RUNNING')
 UNION ALL SELECT 'positive', 'records_written', execution_id, CAST(records_written AS VARCHAR) FROM exec_log WHERE records_written <= 0
 UNION ALL SELECT 'not_null', 'finished_at', execution_id, NULL FROM exec_log WHERE finished_at IS NULL
 UNION ALL SELECT 'max_length', 'run_id', execution_id, run_id FROM exec_log WHERE length(run_id) > 15
 UNION ALL SELECT 'unique', 'pipeline_name,environment_name,run_id,attempt_number', concat_ws(',', pipeline_name, environment_name, run_id,
 CAST(attempt_number AS VARCHAR)), CAST(count(*) AS VARCHAR) FROM exec_log GROUP BY pipeline_name, environment_name, run_id, attempt_number HAVING count(*) > 1
 UNION ALL SELECT 'foreign_key', 'supplier', execution_id, CAST(supplier AS VARCHAR) FROM exec_log WHERE supplier NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)"""
)
def check_rules(spark, sf):
    suppliers = load(spark, sf, "supplier").where("s_nationkey < 20")
    rules = [
        ("allowed", "status", ["SUCCESS", "RUNNING"]),
        ("positive", "records_written"),
        ("not_null", "finished_at"),
        ("max_length", "run_id", 15),
        ("unique", ATTEMPT_KEY),
        ("foreign_key", ["supplier"], suppliers, ["s_suppkey"]),
    ]
    return quality.check_rules(exec_log(spark, sf), rules, "execution_id")


FINDINGS = [
    "p_brand AS scan_id",
    "CASE WHEN p_partkey % 31 = 0 THEN '' ELSE concat('CVE-', p_partkey) END AS id",
    "CASE p_size % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'High' WHEN 3 THEN 'CRITICAL' END AS severity",
    "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_type END AS asset_type",
    "CASE p_partkey % 4 WHEN 0 THEN 'not-applicable' WHEN 3 THEN 'unknown' ELSE 'applicable' END AS applicability",
    "CASE p_partkey % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'remediated' WHEN 2 THEN 'risk-accepted' WHEN 3 THEN 'vendor-backport' "
    "WHEN 4 THEN 'not-applicable' ELSE 'remediated' END AS decision",
    "CASE WHEN p_partkey % 3 = 0 THEN concat('v', p_size) END AS fixed_version",
    "CASE WHEN p_partkey % 5 = 0 THEN 'AP-1' END AS approval_reference",
    "CASE WHEN p_partkey % 6 = 0 THEN 'adv' END AS vendor_advisory",
    "p_partkey % 8 AS evidence_count",
]
FINDINGS_SQL = f"""findings AS (SELECT {", ".join(FINDINGS)} FROM part),
failed AS (
 SELECT scan_id, id, ': applicable ' || upper(severity) || ' vulnerability is still open' AS e FROM findings
 WHERE upper(severity) IN ('MEDIUM', 'HIGH', 'CRITICAL') AND applicability = 'applicable' AND decision = 'open'
 UNION ALL SELECT scan_id, id, ': risk acceptance requires approval_reference' FROM findings WHERE upper(severity) IN ('MEDIUM', 'HIGH', 'CRITICAL')
 AND applicability = 'applicable' AND decision = 'risk-accepted' AND approval_reference IS NULL
 UNION ALL SELECT scan_id, id, ': remediation requires fixed_version' FROM findings WHERE upper(severity) IN ('MEDIUM', 'HIGH', 'CRITICAL')
 AND applicability = 'applicable' AND decision = 'remediated' AND fixed_version IS NULL
 UNION ALL SELECT scan_id, id, ': not-applicable decision requires evidence' FROM findings WHERE applicability = 'not-applicable' AND evidence_count = 0
 UNION ALL SELECT scan_id, id, ': vendor-backport requires vendor_advisory' FROM findings WHERE decision = 'vendor-backport' AND vendor_advisory IS NULL
 UNION ALL SELECT scan_id, id, ': asset_type is required' FROM findings WHERE asset_type = '')"""


def _findings(spark, sf):
    found = load(spark, sf, "part").selectExpr(*FINDINGS)
    refs = F.when(F.col("evidence_count") > 0, F.array_repeat(F.lit("note"), F.col("evidence_count").cast("int")))
    return found.withColumn("evidence", refs).drop("evidence_count")


@query(with_sql(FINDINGS_SQL) + "SELECT scan_id, id, CASE WHEN id = '' THEN 'unknown' ELSE id END || e AS error FROM failed")
def vulnerability_errors(spark, sf):
    return quality.vulnerability_errors(_findings(spark, sf)).select("scan_id", "id", F.explode("errors").alias("error"))


@query(
    with_sql(FINDINGS_SQL)
    + """SELECT f.scan_id, f.n AS findings, coalesce(e.n, 0) AS errors, e.n IS NULL AS passed
 FROM (SELECT scan_id, count(*) AS n FROM findings GROUP BY 1) f LEFT JOIN (SELECT scan_id, count(*) AS n FROM failed GROUP BY 1) e USING (scan_id)"""
)
def vulnerability_gate(spark, sf):
    return quality.vulnerability_gate(_findings(spark, sf))


@query(
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 23 = 0 THEN 'not JSON' WHEN o_orderkey % 29 = 0 THEN 'not an object' END,
 CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 THEN concat_ws('|', CASE WHEN o_custkey % 5 = 0 THEN 'missing warnings' END,
 CASE WHEN o_custkey % 10 = 1 THEN 'type of warnings' END, CASE WHEN o_custkey % 3 = 0 THEN 'wrong schema_version' END,
 CASE WHEN o_custkey % 6 IN (1, 3) THEN 'wrong complete' END, CASE WHEN o_custkey % 8 IN (2, 5) THEN 'wrong revision' END,
 CASE WHEN o_orderstatus = 'P' THEN 'unknown analysis_mode' END, CASE WHEN o_custkey % 9 IN (4, 5) THEN 'unknown level' END,
 CASE WHEN o_custkey % 4 = 0 THEN 'length of parser_truth_digest' END, CASE WHEN o_custkey % 7 = 0 THEN 'extra zz' END) END) AS contract_errors FROM orders"""
)
def check_contract(spark, sf):
    doc = """CASE WHEN o_orderkey % 23 = 0 THEN '{"schema' WHEN o_orderkey % 29 = 0 THEN '[1]' ELSE concat('{"schema_version": ',
      CASE WHEN o_custkey % 6 = 3 THEN '1.0' WHEN o_custkey % 3 = 0 THEN '"1.1"' ELSE '"1.0"' END, ', "complete": ', CASE o_custkey % 6 WHEN 1 THEN '"true"'
      WHEN 3 THEN '1' ELSE 'true' END, ', "revision": ', CASE o_custkey % 8 WHEN 2 THEN '"1"' WHEN 5 THEN 'true' WHEN 7 THEN '1.0' ELSE '1' END,
      ', "level": ', CASE o_custkey % 9 WHEN 4 THEN '"2"' WHEN 5 THEN '3' WHEN 6 THEN 'null' WHEN 7 THEN '"high"' ELSE '2' END,
      ', "analysis_mode": "', CASE o_orderstatus WHEN 'P' THEN 'x' WHEN 'F' THEN 'ai' ELSE 'fallback' END,
      '", "parser_truth_digest": ', CASE WHEN o_custkey % 8 = 0 THEN '1234' WHEN o_custkey % 4 = 0 THEN '"ab"' ELSE concat('"', sha2(o_orderpriority, 256), '"') END,
      CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 10 = 1 THEN ', "warnings": {}' ELSE ', "warnings": []' END,
      CASE WHEN o_custkey % 7 = 0 THEN ', "zz": 1' ELSE '' END, '}') END AS doc"""
    names = ["schema_version", "complete", "revision", "level", "analysis_mode", "parser_truth_digest", "warnings"]
    contract = {
        "required": names,
        "types": {"warnings": "array"},
        "constants": {"schema_version": "1.0", "complete": True, "revision": 1},
        "enums": {"analysis_mode": ["ai", "fallback"], "level": [1, 2, None, "high"]},
        "lengths": {"parser_truth_digest": 64},
        "closed": names,
    }
    checked = quality.check_contract(load(spark, sf, "orders").selectExpr("o_orderkey", doc), "doc", contract)
    return checked.select("o_orderkey", F.array_join("contract_errors", "|").alias("contract_errors"))


TOKENS = ["10.0.0.", "192.168.", "password", "@"]


@query(
    f"""SELECT doc_id, token, instr(text, token) AS at FROM documents JOIN (VALUES {_values((t,) for t in TOKENS)}) v(token)
 ON contains(text, token)"""
)
def scan_tokens(spark, sf):
    return quality.scan_tokens(load(spark, sf, "documents").select("doc_id", "text"), "text", TOKENS)


@query(
    """SELECT doc_id, m AS missing_marker FROM documents JOIN (VALUES ('the'), ('License'), ('é')) v(m) ON NOT contains(text, m)"""
)
def require_markers(spark, sf):
    return quality.require_markers(load(spark, sf, "documents").select("doc_id", "text"), "text", ["the", "License", "é"])


def _files(spark, sf):
    return load(spark, sf, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), "page_id")


@query("SELECT url AS path, sha256(html) AS sha256 FROM pages")
def build_manifest(spark, sf):
    return quality.build_manifest(_files(spark, sf))


@query(
    """SELECT url || page_id AS path, CASE page_id % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' ELSE 'changed' END AS state FROM pages WHERE page_id % 9 < 3"""
)
def verify_manifest(spark, sf):
    files = _files(spark, sf).withColumn("path", F.concat("path", F.col("page_id").cast("string")))
    manifest = quality.build_manifest(files.where("page_id % 9 <> 1"))
    changed = F.when(F.col("page_id") % 9 == 2, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("content"))
    return quality.verify_manifest(files.where("page_id % 9 <> 0").withColumn("content", changed), manifest)
