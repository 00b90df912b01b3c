"""Queries for extraction and lineage over the corpus of definition files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import lineage
from tracewell.plans.corpus import COLUMNS, ERROR, FMT, ITEMS_SQL, KEYS, PATH, artifact_src, stored_tables
from tracewell.plans.views import load, with_sql
from tracewell.session import work_path
from tracewell.sources import artifacts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


ITEM_COLUMNS = ["artifact_id", "position", "evidence_id", "sql_id", "kind", "locator", "value", *COLUMNS]


def _extraction(fmt: str):
    def run(spark, sf):
        return artifacts.extract(artifact_src(spark, sf).where(F.col("fmt") == fmt)).where("kind <> 'error'").select(*ITEM_COLUMNS)

    return run


for _name, _fmt in (("extract_hop_xml", "hop"), ("extract_ktr", "ktr"), ("extract_kjb", "kjb"), ("extract_legacy_json", "json")):
    query(with_sql(ITEMS_SQL) + f"SELECT {', '.join(ITEM_COLUMNS)} FROM items WHERE fmt = '{_fmt}'", _name)(_extraction(_fmt))


@query(f"WITH keyed AS (SELECT {KEYS} FROM orders) SELECT {PATH} AS artifact_id, {ERROR} AS error FROM keyed WHERE {ERROR} IS NOT NULL")
def extraction_errors(spark, sf):
    return artifacts.metadata_tables(artifacts.extract(artifact_src(spark, sf)))["errors"].drop("path")


@query(
    """SELECT concat('page_id=', page_id) AS folder, 'page' AS stem, 'hop' AS fmt, sha256(concat(html, chr(10))) AS source_sha256
 FROM pages"""
)
def read_artifacts(spark, sf):
    folder = work_path(spark, "pages")
    pages = load(spark, sf, "pages").repartition("page_id")
    pages.select("page_id", F.col("html").alias("value")).write.partitionBy("page_id").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(
        F.concat(F.regexp_extract("path", r"(page_id=\d+)", 1), F.lit("/page.HPL")).alias("path"),
        F.col("content").cast("string").alias("content"),
        F.sha2("content", 256).alias("source_sha256"),
    )
    return artifacts.route_artifacts(named).select(
        F.regexp_extract("path", r"^([^/]+)/", 1).alias("folder"), "stem", "fmt", "source_sha256"
    )


@query(
    with_sql(ITEMS_SQL)
    + "SELECT artifact_id, position, name, role, classification FROM items WHERE kind = 'table' AND is_table"
)
def classify_role(spark, sf):
    return stored_tables(spark, sf)["tables"].select("artifact_id", "position", "name", "role", "classification")


@query(
    with_sql(ITEMS_SQL)
    + """SELECT artifact_id, sql_id, i AS position, CASE i WHEN 0 THEN 'grid.readings_' || (c % 7) ELSE 'assets.meters_' || (c % 3) END
 AS table_name FROM items CROSS JOIN (VALUES (0), (1)) v(i) WHERE kind = 'sql'"""
)
def sql_table_refs(spark, sf):
    statements = stored_tables(spark, sf)["sql_statements"]
    return statements.select(
        "artifact_id", "sql_id", F.posexplode(text.sql_tables(F.col("statement"))).alias("position", "table_name")
    )


RESOLVED_SQL = """names AS (SELECT artifact_id, name, arg_max(step_id, position) AS step_id FROM items WHERE kind = 'step' GROUP BY 1, 2),
resolved AS (SELECT h.artifact_id, h.position, h.evidence_id, h.from_name, h.to_name, coalesce(a.step_id, h.from_name) AS from_id,
 coalesce(b.step_id, h.to_name) AS to_id FROM items h LEFT JOIN names a ON a.artifact_id = h.artifact_id AND a.name = h.from_name
 LEFT JOIN names b ON b.artifact_id = h.artifact_id AND b.name = h.to_name WHERE h.kind = 'hop' AND h.enabled)"""
ATTACHED_SQL = """candidates AS (SELECT artifact_id, position, step_id, concat_ws('.', nullif(schema_name, ''), nullif(table_name, '')) AS name
 FROM items WHERE kind = 'step' UNION ALL SELECT artifact_id, position, step_id, table_name FROM items WHERE kind = 'step'),
owners AS (SELECT artifact_id, name, arg_min(step_id, position) AS step_id FROM candidates WHERE name <> '' GROUP BY 1, 2),
attached AS (SELECT e.artifact_id, e.position, e.evidence_id, e.role AS direction, e.name, e.classification,
 coalesce(e.step_id, o.step_id) AS step_id FROM items e LEFT JOIN owners o ON o.artifact_id = e.artifact_id AND o.name = e.name
 WHERE e.kind = 'table' AND e.is_endpoint)"""
DEPENDENCIES_SQL = """dependencies AS (SELECT artifact_id, from_id, to_id, min(position) AS position, arg_min(evidence_id, position)
 AS evidence_refs FROM resolved GROUP BY 1, 2, 3)"""
REACH_SQL = """reach AS (SELECT DISTINCT artifact_id, step_id AS start, step_id AS node FROM attached
 WHERE direction = 'source' AND step_id IS NOT NULL
 UNION SELECT r.artifact_id, r.start, d.to_id FROM reach r JOIN dependencies d ON d.artifact_id = r.artifact_id AND d.from_id = r.node)"""
FLOW_SQL = """flow AS (SELECT s.artifact_id, 'table_flow' AS kind, 'table:' || s.name AS src, 'table:' || t.name AS dst,
 'inferred-deterministic' AS classification, 'reachable explicit step dependency path' AS derivation,
 CASE WHEN s.evidence_id = t.evidence_id THEN s.evidence_id ELSE s.evidence_id || ',' || t.evidence_id END AS evidence_refs
 FROM attached s JOIN reach r ON r.artifact_id = s.artifact_id AND r.start = s.step_id
 JOIN attached t ON t.artifact_id = s.artifact_id AND t.step_id = r.node WHERE s.direction = 'source' AND t.direction = 'target')"""
STEP_EDGE_SQL = """SELECT artifact_id, 'step_dependency' AS kind, 'step:' || from_id AS src, 'step:' || to_id AS dst, 'structural' AS classification,
 CAST(NULL AS VARCHAR) AS derivation, evidence_id AS evidence_refs FROM resolved"""
RW_SQL = """SELECT artifact_id, CASE direction WHEN 'source' THEN 'reads_from' ELSE 'writes_to' END AS kind,
 CASE direction WHEN 'source' THEN 'table:' || name ELSE 'step:' || step_id END AS src,
 CASE direction WHEN 'source' THEN 'step:' || step_id ELSE 'table:' || name END AS dst,
 CASE WHEN coalesce(classification, 'structural') = 'structural' THEN 'structural' ELSE 'inferred-deterministic' END AS classification,
 CASE WHEN classification <> 'structural' THEN classification END AS derivation, evidence_id AS evidence_refs FROM attached WHERE step_id IS NOT NULL"""
WORKFLOW_SQL = """SELECT d.artifact_id, 'workflow_dependency' AS kind, 'pipeline:' || p.name AS src, 'pipeline:' || d.to_name AS dst,
 'structural' AS classification, CAST(NULL AS VARCHAR) AS derivation, d.evidence_id AS evidence_refs
 FROM items d JOIN items p ON p.artifact_id = d.artifact_id AND p.kind = 'pipeline' WHERE d.kind = 'pipeline_dependency'"""
GRAPH = with_sql(ITEMS_SQL, RESOLVED_SQL, ATTACHED_SQL, DEPENDENCIES_SQL, REACH_SQL, FLOW_SQL, recursive=True)


def flat(df):
    return df.withColumn("evidence_refs", F.array_join("evidence_refs", ","))


def parts(spark, sf):
    t = stored_tables(spark, sf)
    return t, lineage.attach_endpoints(t["endpoints"], t["steps"]), lineage.step_dependencies(t["hops"], t["steps"])


@query(
    with_sql(ITEMS_SQL, RESOLVED_SQL)
    + "SELECT artifact_id, position, from_name, to_name, from_id, to_id, evidence_id AS evidence_refs FROM resolved"
)
def resolve_hops(spark, sf):
    t = stored_tables(spark, sf)
    return flat(lineage.resolve_hops(t["hops"], t["steps"]))


@query(
    with_sql(ITEMS_SQL, ATTACHED_SQL)
    + "SELECT artifact_id, position, direction, name, step_id, classification, evidence_id AS evidence_refs FROM attached"
)
def attach_endpoints(spark, sf):
    return flat(parts(spark, sf)[1]).drop("kind", "connection")


@query(
    with_sql(ITEMS_SQL, RESOLVED_SQL, DEPENDENCIES_SQL)
    + "SELECT artifact_id, from_id, to_id, position, evidence_refs, 'structural' AS classification FROM dependencies"
)
def step_dependencies(spark, sf):
    return flat(parts(spark, sf)[2]).drop("from_name", "to_name")


@query(with_sql(ITEMS_SQL, ATTACHED_SQL) + RW_SQL)
def read_write_edges(spark, sf):
    return flat(lineage.read_write_edges(parts(spark, sf)[1]))


@query(with_sql(ITEMS_SQL) + WORKFLOW_SQL)
def workflow_edges(spark, sf):
    t = stored_tables(spark, sf)
    return flat(lineage.workflow_edges(t["dependencies"], t["pipelines"]))


@query(
    with_sql(ITEMS_SQL)
    + """SELECT artifact_id, step_id, name, target_name, data_type, expression, 'structural-field-declaration' AS lineage_classification,
 evidence_id AS evidence_refs FROM items WHERE kind = 'field'"""
)
def column_declarations(spark, sf):
    return flat(lineage.column_declarations(stored_tables(spark, sf)["fields"])).drop("position")


@query(GRAPH + "SELECT artifact_id, start, node FROM reach")
def reachable_pairs(spark, sf):
    _, attached, dependencies = parts(spark, sf)
    starts = attached.where("direction = 'source' AND step_id IS NOT NULL").select("artifact_id", "step_id")
    return lineage.reachable_pairs(dependencies, starts)


@query(GRAPH + "SELECT * FROM flow")
def table_flow(spark, sf):
    _, attached, dependencies = parts(spark, sf)
    return flat(lineage.table_flow(attached, dependencies))


@query(GRAPH + f"{STEP_EDGE_SQL} UNION ALL {RW_SQL} UNION ALL {WORKFLOW_SQL} UNION ALL SELECT * FROM flow")
def lineage_edges(spark, sf):
    return flat(lineage.lineage_edges(stored_tables(spark, sf)))


@query(
    with_sql(ITEMS_SQL)
    + """SELECT s.artifact_id, s.name AS source, t.name AS target, s.refs || ',' || t.refs AS evidence_refs
 FROM (SELECT artifact_id, name, string_agg(evidence_id, ',' ORDER BY position) AS refs FROM items
       WHERE kind = 'table' AND is_endpoint AND role = 'source' GROUP BY 1, 2) s
 JOIN (SELECT artifact_id, name, string_agg(evidence_id, ',' ORDER BY position) AS refs FROM items
       WHERE kind = 'table' AND is_endpoint AND role = 'target' GROUP BY 1, 2) t USING (artifact_id)
 WHERE s.name LIKE 'grid.%' AND t.name LIKE 'billing.due_%'"""
)
def source_target_pairs(spark, sf):
    endpoints = stored_tables(spark, sf)["endpoints"]
    claimed = load(spark, sf, "orders").selectExpr(KEYS.split(",")[0], KEYS.split(",")[1].strip()).selectExpr(
        f"{PATH} AS artifact_id",
        "explode(array(concat('grid.readings_', c % 7), concat('grid.late_', c % 4), 'grid.none')) AS source",
        "concat('billing.due_', k % 11) AS target",
    )
    return flat(lineage.pair_evidence(claimed, endpoints))
