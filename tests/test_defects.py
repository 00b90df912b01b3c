"""Broken, hostile and repeated input: nothing crashes, leaks, multiplies or is lost."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import audit, migration, results
from tracewell.session import work_path
from tracewell.sources.artifacts import extract, route_artifacts
from tracewell.sources.tables import update_by_key
from tracewell.streaming import lifecycle


def items(spark, name, content):
    files = spark.createDataFrame([(name, content, "x")], "path string, content string, source_sha256 string")
    return [(r["kind"], r["value"]) for r in extract(route_artifacts(files)).orderBy("position").collect()]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("'" + "''" * 100_000 + "'", text.REDACTED_LITERAL),
        ("a 'b''c' d 'e", f"a {text.REDACTED_LITERAL} d 'e"),
        ("x ''' y", f"x {text.REDACTED_LITERAL}' y"),
        ("'" + "a''" * 50_000, text.REDACTED_LITERAL + "'"),  # the last quote has no end
    ],
)
def test_long_and_open_literals(spark, sql, want):
    got = spark.createDataFrame([(sql,)], "s string").select(text.redact_sql_literals(F.col("s")).alias("r")).first()["r"]
    assert got == want


def test_no_secret_in_variant_or_typed_map(spark):
    df = spark.sql(
        """SELECT parse_json('{"password": "hunter2", "a": [{"token": 1}]}') AS v, map('password', 5, 'n', 6) AS m,
        array(parse_json('{"secret": 2, "b": 3}')) AS av, map('k', named_struct('passwd', 'x', 'b', 1)) AS ms"""
    )
    row = text.redact_keys(df).select(F.to_json("v").alias("v"), "m", F.to_json("av").alias("av"), "ms").first()
    assert json.loads(row["v"]) == {"password": text.REDACTED, "a": [{"token": text.REDACTED}]}
    assert row["m"] == {"password": text.REDACTED, "n": "6"}
    assert json.loads(row["av"]) == [{"secret": text.REDACTED, "b": 3}]
    assert json.loads(row["ms"]["k"]) == {"passwd": text.REDACTED, "b": 1}


@pytest.mark.parametrize("body", ['{"steps": [{"id": "s"}, 5]}', '{"connections": ["x"]}', '{"steps": null}', '{"steps": [{"fields": [7]}]}'])
def test_json_of_another_shape_is_an_error_item(spark, body):
    assert items(spark, "a.json", body) == [("error", "unexpected JSON shape")]


def test_first_of_repeated_elements_and_real_variables_only(spark):
    body = (
        "<transformation><info><name>A</name><name>B</name></info><step><name>S</name><name>T</name><type>X</type>"
        "<sql><![CDATA[select '<variables><variable><name>FAKE</name></variable></variables>' from t]]></sql></step>"
        "<!-- <variables><variable><name>GONE</name></variable></variables> -->"
        "<variables><variable><name><![CDATA[R&D]]></name><value>1</value></variable></variables></transformation>"
    )
    found = items(spark, "a.ktr", body)
    assert found[0] == ("pipeline", "A") and ("step", "S:X") in found
    assert [v for k, v in found if k == "variable"] == ["R&D"]


def test_a_repeated_key_is_an_error_and_null_keys_match_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, v string")
    assert {tuple(r) for r in update_by_key(target, updates, ["k"], ["v"]).collect()} == {(1, "x"), (2, "b")}
    with pytest.raises(Exception, match="more than once"):
        update_by_key(target, updates.union(updates), ["k"], ["v"]).collect()


def test_run_with_two_counted_inputs(spark):
    path, out = work_path(spark, "changes"), work_path(spark, "out")
    identity = {"pipeline_name": "p", "environment_name": "E", "run_id": "r", "attempt_number": 1}

    def job(count):
        return count(spark.range(5)).join(count(spark.range(3)), "id")

    done = audit.audited_run(spark, identity, job, lambda df: df.write.parquet(out), path)
    assert (done["records_read"], done["records_written"]) == (8, 3)
    with pytest.raises(RuntimeError, match="no action"):
        audit.audited_run(spark, identity, job, lambda df: None, path, patience=1)


WHOLE = {
    "pipeline_summary": {"text": "t", "evidence_refs": ["ev-1"]}, "business_logic": [], "sql_explanations": [{"sql_id": "sql-1"}],
    "source_target_interpretation": [], "dependency_summary": [], "migration_assistance": [], "warnings": [],
}


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None),
        ({"business_logic": [{"text": "x", "more": {"evidence_refs": ["bad"]}}]}, "unknown evidence refs: ['bad']"),
        ({"extra": [{"evidence_refs": ["ev-1", "b]\"{,\\\"evidence_refs\\\":["]}]}, "unknown evidence refs"),
        ({"extra": {"evidence_refs": [["ev-1"]]}}, "unknown evidence refs"),
        ({"warnings": ['{"evidence_refs":["bad"]}']}, None),
        ({"sql_explanations": "none"}, "no list of objects: sql_explanations"),
        ({"sql_explanations": [5, {"sql_id": "sql-9"}]}, "no list of objects: sql_explanations"),
        ({"sql_explanations": [{"sql_id": "sql-9"}]}, "unknown sql_id: sql-9"),
    ],
)
def test_evidence_is_checked_at_any_depth(spark, change, error):
    answer = spark.createDataFrame([("c", 1, json.dumps({**WHOLE, **change}), None)], "case_id string, attempt int, body string, transport_error string")
    allowed = spark.createDataFrame([("c", "evidence", "ev-1"), ("c", "sql", "sql-1")], "case_id string, kind string, value string")
    got = results.validate_results(answer, allowed).first()["error"]
    assert got is None if error is None else error in got


def test_only_runtime_errors_are_transport_errors(spark):
    def fn(context):
        raise RuntimeError("down") if context == "r" else ValueError("odd")

    contexts = spark.createDataFrame([("a", "r"), ("b", "v")], "artifact_id string, context string")
    got = {r["case_id"]: (r["transport_error"], r["client_error"]) for r in results.analyze(contexts, fn).collect()}
    assert got == {"a": ("down", None), "b": (None, "odd")}


def test_late_attempts_enter_and_repeats_do_not(spark):
    path = work_path(spark, "intake")
    schema = "pipeline_name string, environment_name string, run_id string, attempt_number int"

    def bring(*runs):
        spark.createDataFrame([("p", "E", r, 1) for r in runs], schema).coalesce(1).write.mode("append").parquet(path)

    bring("a", "b")
    stream = lifecycle.stream_dedupe(spark.readStream.schema(schema).parquet(path))
    taken = lifecycle.run_available(stream, "taken", 2, [lambda: bring("c", "a"), lambda: bring("late"), lambda: bring("b", "c")])
    assert sorted(r["run_id"] for r in taken.collect()) == ["a", "b", "c", "late"]


def test_digest_tells_where_a_value_ends(spark):
    rows = [("x\x1f=y", "z"), ("x", "y\x1f=z"), ("x", None), ("x", "")]
    digests = {migration.dataset_digest(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first()["digest"] for r in rows}
    assert len(digests) == len(rows)
