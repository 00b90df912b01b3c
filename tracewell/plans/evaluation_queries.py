"""Queries for scores, usage totals, result validation and context export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, functions as F

from tracewell.operators import evaluation, results
from tracewell.plans.corpus import ERROR, FMT, ITEMS_SQL, PATH, artifact_src, stored_tables
from tracewell.plans.lineage_queries import DEPENDENCIES_SQL, RESOLVED_SQL
from tracewell.plans.views import load, with_sql
from tracewell.session import written
from tracewell.sources.artifacts import extract

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


# The supported step types.
SUPPORTED = [
    "TableInput", "TableOutput", "JoinRows", "DatabaseLookup", "FilterRows", "GroupBy", "START", "TRANS",
    "GetVariable", "RowGenerator", "Sequence", "Update", "SelectValues", "Calculator",
]
_KNOWN = ", ".join(f"'{s.lower()}'" for s in SUPPORTED)
UNSUPPORTED_SQL = f"unsupported AS (SELECT DISTINCT artifact_id, type FROM items WHERE kind = 'step' AND lower(type) NOT IN ({_KNOWN}))"
VALUES_SQL = """found AS (
 SELECT DISTINCT artifact_id AS case_id, 'steps' AS dimension, name AS value FROM items WHERE kind = 'step' AND name <> ''
 UNION SELECT artifact_id, CASE role WHEN 'source' THEN 'sources' ELSE 'targets' END, name FROM items WHERE kind = 'table' AND is_endpoint
 UNION SELECT d.artifact_id, 'dependencies', 'step:' || h.from_name || '->' || h.to_name FROM dependencies d
  JOIN resolved h ON h.artifact_id = d.artifact_id AND h.position = d.position
 UNION SELECT artifact_id, 'dependencies', 'pipeline:' || from_name || '->' || to_name FROM items WHERE kind = 'pipeline_dependency'
 UNION SELECT artifact_id, 'sql', value FROM items WHERE kind = 'sql'
 UNION SELECT artifact_id, 'tables', name FROM items WHERE kind = 'table' AND is_table
 UNION SELECT artifact_id, CASE kind WHEN 'parameter' THEN 'parameters' ELSE 'variables' END, name FROM items WHERE kind IN ('parameter', 'variable')
 UNION SELECT artifact_id, 'unsupported_components', type FROM unsupported)"""
FOUND = with_sql(ITEMS_SQL, RESOLVED_SQL, DEPENDENCIES_SQL, UNSUPPORTED_SQL, VALUES_SQL)


@query(with_sql(ITEMS_SQL, UNSUPPORTED_SQL) + "SELECT * FROM unsupported")
def unsupported_components(spark, sf):
    return evaluation.unsupported_components(stored_tables(spark, sf)["steps"], SUPPORTED)


@query(FOUND + "SELECT * FROM found")
def metric_values(spark, sf):
    return evaluation.metric_values(stored_tables(spark, sf), SUPPORTED)


TRUTH_SQL = """truth AS (SELECT * FROM found WHERE length(value) % 7 <> 0 OR length(case_id) % 2 = 0
 UNION ALL SELECT artifact_id, 'targets', 'lost.table' FROM src WHERE c % 4 = 0),
paired AS (SELECT coalesce(f.case_id, t.case_id) AS case_id, coalesce(f.dimension, t.dimension) AS dimension,
 f.value IS NOT NULL AS a, t.value IS NOT NULL AS e FROM found f FULL JOIN truth t ON f.case_id = t.case_id AND f.dimension = t.dimension AND f.value = t.value),
counted AS (SELECT g.artifact_id AS case_id, d.dimension, count(*) FILTER (WHERE a AND e) AS tp, count(*) FILTER (WHERE a AND NOT e) AS fp,
 count(*) FILTER (WHERE e AND NOT a) AS fn FROM src g CROSS JOIN (VALUES ('steps'), ('sources'), ('targets'), ('dependencies'), ('sql'), ('tables'),
 ('parameters'), ('variables'), ('unsupported_components')) d(dimension) LEFT JOIN paired p ON p.case_id = g.artifact_id AND p.dimension = d.dimension GROUP BY 1, 2),
totals AS (SELECT dimension, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
 count(*) FILTER (WHERE fp = 0 AND fn = 0) AS exact, count(*) AS cases FROM counted GROUP BY 1),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM totals)"""


@query(
    FOUND.rstrip()
    + ",\n"
    + TRUTH_SQL
    + """ SELECT dimension, tp, fp, fn, exact, cases, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(exact / cases, 6) AS exact_match_rate FROM rates"""
)
def confusion_metrics(spark, sf):
    tables = stored_tables(spark, sf)
    found = written(evaluation.metric_values(tables, SUPPORTED), "found")
    numbered = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr(f"{PATH} AS case_id", "c")
    cases = tables["pipelines"].select(F.col("artifact_id").alias("case_id"))
    lost = cases.join(numbered, "case_id").where("c % 4 = 0").select(
        "case_id", F.lit("targets").alias("dimension"), F.lit("lost.table").alias("value")
    )
    kept = found.where("length(value) % 7 <> 0 OR length(case_id) % 2 = 0")
    return evaluation.confusion_metrics(found, kept.unionByName(lost), cases)


CASE_FLAGS = [
    f"{PATH} AS case_id", "k % 97 = 5 AS expected_failure", f"{ERROR} IS NOT NULL AS parse_failed", "c % 10 <> 0 AS exact",
    "c % 50 <> 0 AS repeatable", "c % 25 <> 0 AS truth_preserved",
]


@query(
    f"""WITH keyed AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), cases AS (SELECT {", ".join(CASE_FLAGS)} FROM keyed),
 v AS (SELECT *, NOT expected_failure AND NOT parse_failed AS valid FROM cases)
 SELECT count(*) AS cases, count(*) FILTER (WHERE valid) AS valid_cases,
 round(count(*) FILTER (WHERE parse_failed) / count(*), 6) AS observed_failure_rate,
 round(count(*) FILTER (WHERE expected_failure <> parse_failed) / greatest(1, count(*) FILTER (WHERE NOT expected_failure)), 6) AS unexpected_failure_rate,
 round(count(*) FILTER (WHERE (expected_failure AND parse_failed) OR (valid AND exact)) / count(*), 6) AS exact_case_rate,
 round(count(*) FILTER (WHERE valid AND repeatable) / count(*) FILTER (WHERE valid), 6) AS repeatability_rate,
 round(count(*) FILTER (WHERE valid AND truth_preserved) / count(*) FILTER (WHERE valid), 6) AS truth_preservation_rate FROM v"""
)
def failure_rates(spark, sf):
    cases = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr(*CASE_FLAGS)
    return evaluation.failure_rates(cases)


OBSERVED = [
    "l_orderkey AS case_id", "l_partkey % 9 <> 0 AS has_usage", "l_suppkey % 8 <> 0 AS has_gateway",
    "l_linenumber <> 7 AS pricing_known", "CAST(l_quantity AS BIGINT) AS prompt_tokens", "l_suppkey AS completion_tokens",
    "round(l_discount, 2) AS cost_usd", "l_linenumber % 3 AS attempt_count",
]


@query(
    f"""WITH o AS (SELECT {", ".join(OBSERVED)} FROM lineitem) SELECT case_id,
 CAST(CASE WHEN bool_and(has_usage) THEN sum(prompt_tokens) END AS BIGINT) AS input_tokens,
 CAST(CASE WHEN bool_and(has_usage) THEN sum(completion_tokens) END AS BIGINT) AS output_tokens,
 CASE WHEN bool_and(has_gateway AND pricing_known) THEN round(sum(cost_usd), 8) END AS estimated_cost_usd,
 bool_and(has_gateway AND pricing_known) AS pricing_known,
 CAST(CASE WHEN bool_and(has_gateway) THEN sum(attempt_count) END AS BIGINT) AS gateway_provider_attempt_count FROM o GROUP BY case_id"""
)
def usage_per_case(spark, sf):
    seen = load(spark, sf, "lineitem").selectExpr(*OBSERVED)
    gateway = F.struct("pricing_known", "cost_usd", F.array_repeat(F.lit("try"), F.col("attempt_count").cast("int")).alias("attempts"))
    observations = seen.select(
        "case_id",
        F.when(F.col("has_usage"), F.struct("prompt_tokens", "completion_tokens")).alias("usage"),
        F.when(F.col("has_gateway"), gateway).alias("gateway"),
    )
    return evaluation.usage_per_case(observations)


RECORDS = [
    "o_orderpriority AS provider", "CASE WHEN o_custkey % 2 = 0 THEN 'small' ELSE 'large' END AS model", "o_custkey % 3 + 1 AS ai_request_count",
    "CASE WHEN o_orderpriority <> '1-URGENT' OR o_orderkey % 100 <> 0 THEN o_custkey END AS input_tokens", "o_orderkey AS output_tokens",
    "CASE WHEN o_orderpriority <> '2-HIGH' OR o_orderkey % 100 <> 4 THEN CAST(o_custkey % 1000 AS DOUBLE) / 64 END AS estimated_cost_usd",
    "CAST(o_custkey % 50 AS DOUBLE) AS parser_duration_ms", "CAST(o_custkey % 70 AS DOUBLE) AS ai_latency_ms",
    "CASE WHEN o_orderpriority <> '3-MEDIUM' OR o_orderkey % 100 <> 6 THEN CAST(o_custkey % 90 AS DOUBLE) END AS total_duration_ms",
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS failure_count", "o_custkey % 2 AS retry_count",
]


def _known(value: str, guard: str) -> str:
    return f"CASE WHEN count(*) = count({guard}) THEN sum({value}) END"


TOTAL_COLUMNS = (
    f"count(*) AS pipeline_count, CAST(sum(ai_request_count) AS BIGINT) AS ai_request_count, "
    f"CAST({_known('input_tokens', 'input_tokens')} AS BIGINT) AS input_tokens, CAST({_known('output_tokens', 'output_tokens')} AS BIGINT) AS output_tokens, "
    f"round({_known('estimated_cost_usd', 'estimated_cost_usd')}, 8) AS estimated_cost_usd, "
    f"{_known('parser_duration_ms', 'total_duration_ms')} AS parser_duration_ms, {_known('ai_latency_ms', 'total_duration_ms')} AS ai_latency_ms, "
    f"{_known('total_duration_ms', 'total_duration_ms')} AS total_duration_ms, CAST(sum(failure_count) AS BIGINT) AS failure_count, "
    "CAST(sum(retry_count) AS BIGINT) AS retry_count"
)
RECORDS_SQL = f"records AS (SELECT {', '.join(RECORDS)} FROM orders)"


def _records(spark, sf):
    return load(spark, sf, "orders").selectExpr(*RECORDS)


@query(with_sql(RECORDS_SQL) + f"SELECT {TOTAL_COLUMNS} FROM records")
def usage_totals(spark, sf):
    return evaluation.usage_totals(_records(spark, sf))


@query(with_sql(RECORDS_SQL) + f"SELECT provider, model, {TOTAL_COLUMNS} FROM records GROUP BY provider, model")
def usage_by_model(spark, sf):
    return evaluation.usage_by_model(_records(spark, sf))


@query(
    with_sql(RECORDS_SQL, f"totals AS (SELECT provider, {TOTAL_COLUMNS} FROM records GROUP BY provider)")
    + """SELECT 243 AS pipeline_count, CAST(round_even(ai_request_count / greatest(pipeline_count, 1) * 243, 0) AS BIGINT) AS ai_request_count,
 round(estimated_cost_usd / greatest(pipeline_count, 1) * 243, 6) AS estimated_cost_usd FROM totals"""
)
def project_usage(spark, sf):
    projected = evaluation.project_usage(evaluation.usage_totals(_records(spark, sf), ["provider"]))
    return projected.withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 6))


QUALITY = [
    "CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS structured_output_valid", "l_linenumber % 2 AS factual_consistency",
    "l_discount * 10 AS grounding", "l_tax * 10 AS completeness", "l_discount + l_tax AS semantic_usefulness_proxy",
    "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS parser_truth_preserved", "l_linenumber % 3 AS unsupported_claim_count",
]
SCORES = [q.rsplit(" AS ", 1)[1] for q in QUALITY[:6]]


@query(
    f"WITH q AS (SELECT {', '.join(QUALITY)} FROM lineitem) SELECT count(*) AS evaluated_cases, "
    + ", ".join(f"round(avg({s}), 6) AS {s}" for s in SCORES)
    + ", CAST(sum(unsupported_claim_count) AS BIGINT) AS unsupported_claim_count FROM q"
)
def semantic_summary(spark, sf):
    return evaluation.semantic_summary(load(spark, sf, "lineitem").selectExpr(*QUALITY))


@query(
    """SELECT CAST(sum(strlen(html)) AS BIGINT) AS raw_bytes, CAST(sum(strlen(url)) AS BIGINT) AS structured_bytes,
 round(sum(strlen(url)) / sum(strlen(html)), 6) AS ratio FROM pages"""
)
def byte_ratio(spark, sf):
    return evaluation.byte_ratio(load(spark, sf, "pages"), "html", "url")


@query(
    f"""WITH keyed AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
 SELECT count(*) AS documents, count(*) AS repeatable FROM keyed WHERE {ERROR} IS NULL"""
)
def repeatability(spark, sf):
    """Extracting twice, under another partitioning, gives the same digest for every document."""
    source = artifact_src(spark, sf)
    other = 3 * spark.sparkContext.defaultParallelism + 1
    first, second = (
        extract(a).where("truth_digest IS NOT NULL").select("artifact_id", F.col("truth_digest").alias(n))
        for a, n in ((source, "first"), (source.repartition(other, "stem"), "second"))
    )
    same = F.col("first").eqNullSafe(F.col("second"))
    return first.join(second, "artifact_id", "full").agg(F.count(F.lit(1)).alias("documents"), F.count_if(same).alias("repeatable"))


# Captured answers: one per line item, whose part number decides what is wrong with it.
CASES = f"SELECT o_orderkey AS k, o_custkey AS c, {FMT.replace('k %', 'o_orderkey %')} AS fmt FROM orders"
DEFECT = "p % 8"
SOURCE = "CASE fmt WHEN 'hop' THEN concat('grid.late_', c % 4) ELSE concat('grid.readings_', c % 7) END"
BODY = f"""concat(CASE WHEN s % 3 = 0 THEN '```json\\n' ELSE '' END, CASE WHEN {DEFECT} = 6 THEN 'no answer' ELSE concat(
 '{{"pipeline_summary": {{"text": "bill ', k, '", "evidence_refs": ["ev-0001"]}}, "business_logic": [{{"text": "a", "evidence_refs": ["ev-0002"',
 CASE WHEN {DEFECT} = 2 THEN ', "ev-7777"' ELSE '' END, ']}}, {{"text": "b", "evidence_refs": []}}], "sql_explanations": [',
 CASE WHEN {DEFECT} = 3 THEN '{{"sql_id": "sql-0042", "text": "q", "evidence_refs": ["ev-0003"]}}'
      WHEN fmt <> 'kjb' THEN '{{"sql_id": "sql-0001", "text": "q", "evidence_refs": ["ev-0003"]}}' ELSE '' END,
 '], "source_target_interpretation": [',
 CASE WHEN {DEFECT} = 4 THEN concat('{{"source": "nowhere.meters", "target": "billing.due_', k % 11, '", "text": "x", "evidence_refs": ["ev-0001"]}}')
      WHEN fmt <> 'kjb' THEN concat('{{"source": "', {SOURCE}, '", "target": "billing.due_', k % 11, '", "text": "x", "evidence_refs": ["ev-0001"]}}')
      ELSE '' END,
 '], "dependency_summary": [{{"from": "', CASE WHEN fmt = 'kjb' THEN 'START' ELSE 'Pull Readings' END, '", "to": "',
 CASE WHEN {DEFECT} = 5 THEN 'No Such Step' WHEN fmt = 'kjb' THEN 'Run Billing' ELSE 'Sort By Meter' END, '", "text": "y", "evidence_refs": ["ev-0001"]}}]',
 CASE WHEN {DEFECT} = 1 THEN '' ELSE ', "migration_assistance": [], "warnings": []' END, '}}') END, CASE WHEN s % 3 = 0 THEN '\\n```' ELSE '' END)"""


def _responses(spark, sf):
    tries = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    one = load(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(tries).alias("attempt"), "l_partkey", "l_suppkey")
    cases = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", "c", f"{FMT} AS fmt", f"{PATH} AS case_id")
    answers = one.join(cases, F.col("l_orderkey") == F.col("k")).selectExpr(
        "case_id", "attempt", "k", "c", "fmt", "l_partkey AS p", "l_suppkey AS s"
    )
    return answers.selectExpr(
        "case_id", "attempt", f"CASE WHEN {DEFECT} <> 7 THEN {BODY} END AS body", f"CASE WHEN {DEFECT} = 7 THEN 'timeout' END AS transport_error"
    )


# One case in five was answered before its file got the step name it has now.
EARLIER = "k % 5 = 3"


def _captured(spark, sf):
    """The answers, each with the digest of the truth it was given for; written, as every check reads them again."""
    k = F.regexp_extract("artifact_id", r"/a(\d+)", 1).cast("long").alias("k")
    files = artifact_src(spark, sf).select("*", k).where(EARLIER)
    before = F.regexp_replace("content", "Write Bills|Run Billing", "Send Bills")
    earlier = extract(files.withColumn("content", before).drop("k")).where("truth_digest IS NOT NULL")
    now = stored_tables(spark, sf)["pipelines"].select("artifact_id", "truth_digest", k).where(f"NOT ({EARLIER})").drop("k")
    digests = now.unionByName(earlier.select("artifact_id", "truth_digest"))
    return written(_responses(spark, sf).join(digests.withColumnRenamed("artifact_id", "case_id"), "case_id", "left"), "given")


_TEXT = "'AI result references unknown "
ERRORS_SQL = f"""keyed AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
cases AS (SELECT k, c, {FMT} AS fmt, {PATH} AS case_id, {ERROR} IS NULL AS known FROM keyed),
one AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
 AS attempt FROM lineitem),
answers AS (SELECT case_id, attempt, k, fmt, known, l_partkey AS p, l_suppkey AS s FROM one JOIN cases ON k = l_orderkey),
judged AS (SELECT case_id, attempt, k, known, fmt, CASE WHEN {DEFECT} = 7 THEN 'timeout' END AS transport_error, CASE
 WHEN {DEFECT} IN (6, 7) THEN 'result is not a JSON object'
 WHEN {DEFECT} = 1 THEN 'AI result missing keys: migration_assistance, warnings'
 WHEN NOT known AND {DEFECT} = 2 THEN 'AI result contains unknown evidence refs: [''ev-0001'', ''ev-0002''' || CASE WHEN fmt <> 'kjb' THEN ', ''ev-0003''' ELSE '' END || ', ''ev-7777'']'
 WHEN NOT known THEN 'AI result contains unknown evidence refs: [''ev-0001'', ''ev-0002''' || CASE WHEN fmt <> 'kjb' OR {DEFECT} = 3 THEN ', ''ev-0003''' ELSE '' END || ']'
 WHEN {DEFECT} = 2 THEN 'AI result contains unknown evidence refs: [''ev-7777'']'
 WHEN {DEFECT} = 3 THEN {_TEXT}sql_id: sql-0042'
 WHEN {DEFECT} = 4 THEN {_TEXT}source: nowhere.meters'
 WHEN {DEFECT} = 5 THEN {_TEXT}dependency target: No Such Step' END AS error FROM answers)"""


@query(with_sql(ERRORS_SQL) + "SELECT case_id, attempt, transport_error, error FROM judged")
def validate_results(spark, sf):
    allowed = results.allowed_values(stored_tables(spark, sf))
    return results.validate_results(_responses(spark, sf), allowed).drop("body")


RESOLVED_ANSWERS_SQL = """tried AS (SELECT *, transport_error IS NOT NULL OR error IS NULL AS stops FROM judged WHERE attempt <= 3),
final AS (SELECT case_id, min(k) AS k, min(fmt) AS fmt, coalesce(min(attempt) FILTER (WHERE stops), max(attempt)) AS attempts,
 bool_or(stops) AS stopped FROM tried GROUP BY 1),
resolved_answers AS (SELECT f.case_id, f.k, f.fmt, CASE WHEN t.transport_error IS NULL AND t.error IS NULL THEN 'ai' ELSE 'fallback' END AS analysis_mode,
 f.attempts, f.attempts - 1 AS retry_count, coalesce(t.transport_error, t.error) AS reason
 FROM final f JOIN tried t ON t.case_id = f.case_id AND t.attempt = f.attempts)"""


def _resolved(spark, sf, answers):
    allowed = results.allowed_values(stored_tables(spark, sf))
    return results.resolve_attempts(results.validate_results(answers, allowed), 3), allowed


@query(with_sql(ERRORS_SQL, RESOLVED_ANSWERS_SQL) + "SELECT case_id, analysis_mode, attempts, retry_count, reason FROM resolved_answers")
def resolve_attempts(spark, sf):
    return _resolved(spark, sf, _responses(spark, sf))[0].drop("body")


SIZES_SQL = """sizes AS (SELECT s.artifact_id AS case_id, n_steps, n_sql, n_deps, n_ends FROM
 (SELECT artifact_id, count(*) FILTER (WHERE kind = 'step') AS n_steps, count(*) FILTER (WHERE kind = 'sql') AS n_sql,
  count(*) FILTER (WHERE kind = 'pipeline_dependency') + coalesce(any_value(d.n), 0) AS n_deps,
  count(DISTINCT name) FILTER (WHERE kind = 'table' AND is_endpoint) AS n_ends
  FROM items LEFT JOIN (SELECT artifact_id, count(*) AS n FROM dependencies GROUP BY 1) d USING (artifact_id) GROUP BY 1) s),
scored AS (SELECT r.*, n_steps, n_sql, n_deps, n_ends FROM resolved_answers r LEFT JOIN sizes USING (case_id)),
dims AS (SELECT *,
 list_filter([1.0::DOUBLE, CASE WHEN n_steps > 0 THEN least(2.0::DOUBLE / n_steps, 1) END, CASE WHEN n_sql > 0 THEN 1.0::DOUBLE END,
 CASE WHEN n_deps > 0 THEN least(1.0::DOUBLE / n_deps, 1) END, CASE WHEN n_ends > 0 THEN 2.0::DOUBLE / n_ends END], lambda x: x IS NOT NULL) AS d FROM scored)"""


@query(
    with_sql(ERRORS_SQL.replace("keyed AS", "keyed0 AS").replace("FROM keyed)", "FROM keyed0)"), RESOLVED_ANSWERS_SQL, ITEMS_SQL, RESOLVED_SQL, DEPENDENCIES_SQL, SIZES_SQL)
    + f""", final_scores AS (SELECT case_id, analysis_mode = 'ai' AS ok, CASE WHEN analysis_mode = 'ai' AND {EARLIER} THEN 0 ELSE 1 END AS same, CASE WHEN fmt = 'kjb' THEN 3.0::DOUBLE / 4 ELSE 5.0::DOUBLE / 6 END AS g, list_sum(d) / len(d) AS comp FROM dims)
 SELECT case_id, CASE WHEN ok THEN 1 ELSE 0 END AS structured_output_valid, CASE WHEN ok THEN same ELSE 0 END AS factual_consistency,
 CASE WHEN ok THEN round(g, 6) ELSE 0.0 END AS grounding, CASE WHEN ok THEN round(comp, 6) ELSE 0.0 END AS completeness,
 CASE WHEN ok THEN round((g + comp + same) / 3, 6) ELSE 0.0 END AS semantic_usefulness_proxy,
 CASE WHEN ok THEN 0 ELSE 1 END AS unsupported_claim_count, same AS parser_truth_preserved FROM final_scores"""
)
def result_quality(spark, sf):
    resolved, allowed = _resolved(spark, sf, _captured(spark, sf))
    return results.result_quality(resolved, stored_tables(spark, sf), allowed)


@query(
    with_sql(ITEMS_SQL)
    + """SELECT artifact_id, 'pipeline_summary' AS section, position, name || ' contains ' || n_steps || ' deterministic steps and ' || n_hops || ' declared dependencies.' AS text,
 evidence_id AS evidence_refs FROM items JOIN (SELECT artifact_id, count(*) FILTER (WHERE kind = 'step') AS n_steps, count(*) FILTER (WHERE kind = 'hop') AS n_hops FROM items GROUP BY 1) USING (artifact_id)
 WHERE kind = 'pipeline'
 UNION ALL SELECT artifact_id, 'business_logic', position, 'Step ''' || name || ''' is structurally typed as ''' || type || '''.', evidence_id FROM items WHERE kind = 'step'
 UNION ALL SELECT artifact_id, 'sql_explanations', position, 'SQL is present. Semantic explanation is unavailable without an approved AI client.', evidence_id FROM items WHERE kind = 'sql'
 UNION ALL SELECT artifact_id, 'dependency_summary', position, 'Deterministic dependency: ' || from_name || ' -> ' || to_name || '.', evidence_id FROM items WHERE kind = 'hop' AND enabled
 UNION ALL SELECT artifact_id, 'warnings', position, 'AI semantic analysis unavailable or rejected: timeout', '' FROM items WHERE kind = 'pipeline'"""
)
def fallback_description(spark, sf):
    rows = results.fallback_description(stored_tables(spark, sf), "timeout")
    return rows.withColumn("evidence_refs", F.array_join("evidence_refs", ","))


REDACTED_SQL = "replace(value, '''BILLABLE''', '''[REDACTED_LITERAL]''')"


@query(
    with_sql(ITEMS_SQL, RESOLVED_SQL, DEPENDENCIES_SQL)
    + f"""SELECT artifact_id, max(CASE WHEN kind = 'sql' THEN {REDACTED_SQL} END) AS statement, max(CASE WHEN kind = 'sql' THEN {REDACTED_SQL} END) AS sql_evidence,
 count(*) FILTER (WHERE kind = 'step') AS steps, count(*) FILTER (WHERE kind = 'hop') AS hops, count(*) AS evidence,
 count(*) FILTER (WHERE kind = 'connection') AS connections, count(*) FILTER (WHERE kind = 'field') AS columns,
 count(*) FILTER (WHERE kind = 'parameter') AS parameters, count(*) FILTER (WHERE kind = 'pipeline_dependency') + coalesce(any_value(d.n), 0) AS dependencies,
 max(CASE WHEN kind = 'pipeline' THEN name END) AS pipeline, '1.1' AS schema_version, 1 AS boundaries, 0 AS interpretations, true AS digest_kept,
 false AS leaks FROM items LEFT JOIN (SELECT artifact_id, count(*) AS n FROM dependencies GROUP BY 1) d USING (artifact_id) GROUP BY 1"""
)
def export_context(spark, sf):
    tables = stored_tables(spark, sf)
    contexts = results.export_context(tables)

    # One pass over each document takes its sections apart; every further path is looked up in a section only.
    sections = ["schema_version", "capability_boundaries", "pipeline", "steps", "hops", "sql", "columns", "dependencies", "parameters",
                "connections", "evidence", "parser_truth_digest", "lineage"]
    # A plain search is much faster than one pattern, and only a text with "meters-" needs that.
    plain = reduce(Column.__or__, [F.contains("context", F.lit(w)) for w in ("password", "quarter", "'BILLABLE'")])
    leaks = (plain | (F.contains("context", F.lit("meters-")) & F.col("context").rlike("meters-[0-9]"))).alias("leaks")
    taken = contexts.select("artifact_id", leaks, F.json_tuple("context", *sections).alias(*sections))

    def size(section: str, name: str | None = None) -> Column:
        return F.json_array_length(section).cast("long").alias(name or section)

    sql_at = F.filter(F.from_json("evidence", "array<struct<kind: string, value: string>>"), lambda e: e["kind"] == "sql")
    told = taken.select(
        "artifact_id", F.get_json_object("sql", "$[0].statement").alias("statement"),
        F.get(sql_at, F.lit(0))["value"].alias("sql_evidence"), size("steps"), size("hops"), size("evidence"),
        size("connections"), size("columns"), size("parameters"), size("dependencies"),
        F.get_json_object("pipeline", "$.name").alias("pipeline"), "schema_version", size("capability_boundaries", "boundaries"),
        F.json_array_length(F.get_json_object("lineage", "$.ai_interpretation")).cast("long").alias("interpretations"),
        "parser_truth_digest", "leaks",
    )
    # The digests are joined to the few values that are left of a document, so that no document is sorted.
    now = tables["pipelines"].select("artifact_id", "truth_digest")
    kept = (F.col("parser_truth_digest") == F.col("truth_digest")).alias("digest_kept")
    return told.join(now, "artifact_id").select(*[c for c in told.columns if c not in ("parser_truth_digest", "leaks")], kept, "leaks")


@query(
    with_sql(ERRORS_SQL)
    + f""", taken AS (SELECT * FROM judged WHERE NOT ({EARLIER})),
 asked AS (SELECT c.case_id, a.case_id IS NULL AS none1, b.case_id IS NULL AS none2, a.transport_error AS gone1, b.transport_error AS gone2,
 a.error AS error1, b.error AS error2, a.case_id IS NOT NULL AND a.transport_error IS NULL AND a.error IS NOT NULL AS again
 FROM cases c LEFT JOIN taken a ON a.case_id = c.case_id AND a.attempt = 1 LEFT JOIN taken b ON b.case_id = c.case_id AND b.attempt = 2
 WHERE c.known),
 ended AS (SELECT case_id, again, CASE WHEN again THEN CASE WHEN none2 THEN 'no captured answer' ELSE coalesce(gone2, error2) END
 WHEN none1 THEN 'no captured answer' ELSE coalesce(gone1, error1) END AS reason FROM asked)
 SELECT case_id, CASE WHEN reason IS NULL THEN 'ai' ELSE 'fallback' END AS analysis_mode, CASE WHEN again THEN 2 ELSE 1 END AS attempts,
 CASE WHEN again THEN 1 ELSE 0 END AS retry_count, reason, reason IS NULL AS digest_kept FROM ended"""
)
def analyze(spark, sf):
    tables = stored_tables(spark, sf)
    analyzed = results.analyze_cases(results.export_context(tables), _captured(spark, sf), tables)
    return analyzed.withColumn("digest_kept", F.length("truth_digest").eqNullSafe(F.lit(64))).drop("body", "truth_digest")
