"""Extraction of definition files: order of discovery, roles, leniency; lineage on cyclic and odd graphs."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import lineage, migration
from tracewell.sources.artifacts import classify_role, extract, metadata_tables, read_artifacts

KTR = """<?xml version="1.0"?>
<!-- <step><name>ghost</name></step> -->
<transformation><info><name>enrich</name></info>
<variables><variable><name>TARGET</name><value>dw</value></variable></variables>
<connection><name>old</name><type>PG</type><server>s</server><database>d</database><port>1</port></connection>
<step><name>Read</name><type>TableInput</type><connection>old</connection>
 <sql>SELECT a FROM st.orders o JOIN st.orders x ON 1=1 WHERE s = 'A''B' AND n &lt; 2</sql></step>
<step><name>Look</name><type>DatabaseLookup</type><schema>dim</schema><lookup><table>cust</table></lookup></step>
<step><name>Net</name><type>Calculator</type><fields><field><name>net</name><calculation>amount</calculation></field></fields></step>
<step><name>Write</name><type>TableOutput</type><schema>${TARGET}</schema><table>out</table></step>
<order><hop><from>Read</from><to>Look</to></hop><hop><from>Look</from><to>Net</to><enabled>n</enabled></hop>
<hop><from>Look</from><to>Write</to></hop><hop><from>Read</from><to>Look</to></hop></order></transformation>"""
HPL = """<pipeline><info><name>enrich</name></info>
<transform><name>In</name><type>TableInput</type><connection>c</connection><table>t</table>
 <fields><field><stream_name>f</stream_name></field></fields></transform>
<transform><name>Again</name><type>TableInput</type><connection>c</connection><table>t</table></transform>
<transform><name></name><type>OutputInput</type><table>z</table></transform></pipeline>"""
JSON = """{"pipeline": {"name": "legacy"}, "steps": [{"name": "R", "type": "FileReader", "table": "a", "fields": ["x", {"name": "y"}]},
 {"name": "W", "type": "TableWriter", "table": "b", "role": "bogus"}], "hops": [{"from": "R", "to": "W", "enabled": "false"},
 {"from": "W", "to": "R", "enabled": 0}, {"from": "R", "to": "Unknown", "enabled": null}, {"from": "R", "to": "Unknown"}]}"""
FILES = {
    "a/enrich.ktr": KTR, "b/new.HPL": HPL, "c/legacy.json": JSON, "d/list.json": "[]", "e/broken.ktr": "<transformation><step>",
    "f/notes.md": "x", "g/other.xml": "<project/>", "h/empty.kjb": " \n",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    files = read_artifacts(spark, str(root)).withColumn("artifact_id", F.regexp_extract("path", r"([^/]+)$", 1))
    return extract(files).cache()


@pytest.fixture(scope="module")
def tables(corpus):
    return metadata_tables(corpus)


def listed(df, artifact, *columns):
    return [tuple(r) for r in df.where(F.col("artifact_id") == artifact).orderBy("position").select(*columns).collect()]


def test_errors(tables):
    found = {r["artifact_id"]: r["error"].split(":")[0] for r in tables["errors"].collect()}
    assert found == {
        "list.json": "not a JSON object", "broken.ktr": "malformed XML", "notes.md": "unsupported ETL artifact",
        "other.xml": "unsupported Hop root element", "empty.kjb": "malformed XML",
    }


def test_order_of_discovery(tables):
    kinds = [k for (k,) in listed(tables["evidence"], "enrich.ktr", "kind")]
    assert kinds == ["pipeline", "connection", "variable", "step", "sql", "table", "table", "step", "table", "step", "field", "step",
                     "table", "hop", "hop", "hop", "hop"]
    hop_kinds = [k for (k,) in listed(tables["evidence"], "new.HPL", "kind")]
    assert hop_kinds == ["pipeline", "step", "connection", "field", "table", "step", "table", "step", "table"]
    json_kinds = [k for (k,) in listed(tables["evidence"], "legacy.json", "kind")]
    assert json_kinds == ["pipeline", "step", "field", "field", "table", "step", "table", "hop", "hop", "hop", "hop"]
    assert [i for (i,) in listed(tables["evidence"], "legacy.json", "id")][:2] == ["ev-0001", "ev-0002"]


def test_tables_once_endpoints_by_format(tables):
    assert listed(tables["tables"], "enrich.ktr", "name", "role") == [
        ("st.orders", "source"), ("dim.cust", "referenced"), ("${TARGET}.out", "target")
    ]
    assert listed(tables["tables"], "new.HPL", "name", "role") == [("t", "source"), ("z", "source")]
    assert listed(tables["endpoints"], "new.HPL", "name") == [("t",), ("t",), ("z",)]


def test_names(tables):
    assert listed(tables["steps"], "new.HPL", "name") == [("In",), ("Again",), ("",)]
    assert listed(tables["pipelines"], "enrich.ktr", "kind", "format") == [("pentaho-transformation", "pentaho-xml")]
    config = listed(tables["connections"], "enrich.ktr", "config")[0][0]
    assert config == {"server": "s", "database": "d", "port": "1"}


def test_json_enabled_is_truthiness(tables):
    assert [e for (e,) in listed(tables["hops"], "legacy.json", "enabled")] == [True, False, False, True]


@pytest.mark.parametrize(
    "step_type, hop, pentaho, legacy",
    [
        ("InputOutput", "source", "target", "source"), ("TextWriter", "referenced", "target", "target"),
        ("CsvReader", "referenced", "source", "source"), ("TableOutput", "target", "target", "target"), ("Sort", *["referenced"] * 3),
    ],
)
def test_role_precedence(spark, step_type, hop, pentaho, legacy):
    row = spark.range(1).select(*[classify_role(F.lit(step_type), F.lit(f)).alias(f) for f in ("hop", "ktr", "json")]).first()
    assert (row["hop"], row["ktr"], row["json"]) == (hop, pentaho, legacy)


def test_edges(tables):
    edges = lineage.lineage_edges(tables).where("artifact_id = 'enrich.ktr'")
    count = {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()}
    assert count == {"step_dependency": 3, "reads_from": 1, "writes_to": 1, "table_flow": 1}
    assert lineage.step_dependencies(tables["hops"], tables["steps"]).where("artifact_id = 'enrich.ktr'").count() == 2
    read = edges.where("kind = 'reads_from'").first()
    assert read["classification"] == "inferred-deterministic" and read["derivation"]


def test_unknown_hop_name_stands_for_itself(tables):
    ids = {tuple(r) for r in lineage.resolve_hops(tables["hops"], tables["steps"]).where("artifact_id = 'legacy.json'").select("from_id", "to_id").collect()}
    assert ids == {("step-0001", "step-0002"), ("step-0001", "Unknown")}


def test_first_step_of_a_table_gets_the_endpoint(tables):
    attached = lineage.attach_endpoints(tables["endpoints"], tables["steps"])
    assert listed(attached, "new.HPL", "step_id") == [("step-0001",), ("step-0001",), ("step-0003",)]


def test_reachability_with_cycles(spark):
    edges = [("x", a, b) for a, b in ("ab", "bc", "ca", "cd", "ef")] + [("y", "a", "z")]
    df = spark.createDataFrame(edges, "artifact_id string, from_id string, to_id string")
    starts = spark.createDataFrame([("x", "a"), ("x", "e"), ("y", "q")], "artifact_id string, step_id string")
    got = {tuple(r) for r in lineage.reachable_pairs(df, starts).collect()}
    assert got == {("x", "a", n) for n in "abcd"} | {("x", "e", "e"), ("x", "e", "f"), ("y", "q", "q")}


def test_reachability_of_nothing(spark):
    edges = spark.createDataFrame([], "artifact_id string, from_id string, to_id string")
    starts = spark.createDataFrame([], "artifact_id string, step_id string")
    assert lineage.reachable_pairs(edges, starts).count() == 0


def test_same_estate_migrates(tables, spark):
    pairs = spark.createDataFrame([("enrich.ktr", "enrich.ktr"), ("enrich.ktr", "new.HPL")], "legacy_id string, target_id string")
    status = {r["target_id"]: r["status"] for r in migration.migration_status(migration.validate_migration(tables, tables, pairs)).collect()}
    assert status == {"enrich.ktr": "PASS", "new.HPL": "FAIL"}


def test_digest_does_not_depend_on_partitioning(corpus):
    digests = corpus.where("truth_digest IS NOT NULL").select("artifact_id", "truth_digest").collect()
    assert len({r["truth_digest"] for r in digests}) == 3


def test_table_flow_computes_endpoints_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(step):
        seen.add(1)
        return step

    rows = [("a", 0, "s1", "source", "t1", ["e1"]), ("a", 1, "s2", "target", "t2", ["e2"]), ("a", 2, None, "target", "t3", ["e3"])]
    given = spark.createDataFrame(rows, "artifact_id string, position int, step_id string, direction string, name string, evidence_refs array<string>")
    attached = given.withColumn("step_id", F.udf(count, "string").asNondeterministic()("step_id"))
    edges = spark.createDataFrame([("a", "s1", "s2")], "artifact_id string, from_id string, to_id string")
    flow = [(r["src"], r["dst"], r["evidence_refs"]) for r in lineage.table_flow(attached, edges).collect()]
    assert flow == [("table:t1", "table:t2", ["e1", "e2"])]
    assert seen.value == len(rows)
