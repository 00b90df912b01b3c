"""Scalar functions and quality gates on small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import numeric, text
from tracewell.operators import evaluation, keyed, quality, results
from tracewell.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("a = 'x'", "a = '[REDACTED_LITERAL]'"), ("a = 'it''s' b", "a = '[REDACTED_LITERAL]' b"), ("'' or ''", "'[REDACTED_LITERAL]' or '[REDACTED_LITERAL]'"),
        ("'abc''", "'[REDACTED_LITERAL]''"), ("no quotes", "no quotes"), ("'" + "y" * 50000 + "'", "'[REDACTED_LITERAL]'"),
    ],
)
def test_redact_sql(spark, sql, want):
    assert one(spark, text.redact_sql_literals(F.lit(sql))) == want


def test_sql_digest_ignores_case_and_space(spark):
    digests = {one(spark, text.sql_digest(F.lit(s))) for s in ("SELECT 'A'", " select\n\t'a' ", "Select 'A'")}
    assert len(digests) == 1


@pytest.mark.parametrize(
    "body, want",
    [("```json\n{}\n```", "{}"), ("  {} ", "{}"), ("``` x ```", ""), ("```\n{\n}\n```\n", "{\n}"), ("```json\r\n{}\r\n```", "{}"), ("```\n{}", "```\n{}")],
)
def test_code_fence(spark, body, want):
    assert one(spark, text.strip_code_fence(F.lit(body))) == want


def test_expand_template_takes_dollar_names_literally(spark):
    params = F.create_map(F.lit("A"), F.lit("$1"), F.lit("B"), F.lit(None).cast("string"))
    assert one(spark, text.expand_template(F.lit("${A}-${B}-${C}"), params)) == "$1--${C}"


def test_sql_tables(spark):
    sql = "WITH c AS (select 1) SELECT * FROM ${S}.t1 JOIN c ON 1=1 left join \"q\" , t3"
    assert one(spark, text.sql_tables(F.lit(sql))) == ["${S}.t1", "c"]


def test_redact_typed(spark):
    df = spark.sql("SELECT 1 AS id, 'p' AS my_password, named_struct('a', map('Token', 'x', 'ok', 'y'), 'credential', array(1)) AS s")
    row = text.redact_keys(df).first().asDict(recursive=True)
    assert row == {"id": 1, "my_password": "[REDACTED]", "s": {"a": {"Token": "[REDACTED]", "ok": "y"}, "credential": "[REDACTED]"}}


def test_redact_json(spark):
    doc = {"a": [{"api-key": {"x": 1}}, 2], "PASSWD": None, "t": "é"}
    got = json.loads(one(spark, text.redact_keys_json(F.lit(json.dumps(doc)))))
    assert got == {"a": [{"api-key": "[REDACTED]"}, 2], "PASSWD": "[REDACTED]", "t": "é"}
    assert one(spark, text.redact_keys_json(F.lit("no json"))) is None


def test_band(spark):
    got = [one(spark, numeric.band(F.lit(v).cast("double"), numeric.AGE_STEPS)) for v in (0, 1800, 3599, 3600, None)]
    assert got == ["green", "orange", "orange", "red", None]


FINDING = "scan_id string, id string, severity string, asset_type string, applicability string, decision string, fixed_version string, approval_reference string, vendor_advisory string, evidence array<string>"


@pytest.mark.parametrize(
    "row, errors",
    [
        (("A", "high", "os", "applicable", "open", None, None, None, []), ["A: applicable HIGH vulnerability is still open"]),
        (("A", "LOW", "os", "applicable", "open", None, None, None, []), []),
        (("A", "HIGH", "os", "Applicable", "open", None, None, None, []), []),
        (("A", "HIGH", "os", "applicable", "remediated", "", None, None, []), ["A: remediation requires fixed_version"]),
        (("A", "HIGH", "os", "applicable", "risk-accepted", None, None, None, []), ["A: risk acceptance requires approval_reference"]),
        ((None, "LOW", None, "not-applicable", "vendor-backport", None, None, None, None),
         ["unknown: not-applicable decision requires evidence", "unknown: vendor-backport requires vendor_advisory", "unknown: asset_type is required"]),
    ],
)
def test_vulnerability_rules(spark, row, errors):
    df = spark.createDataFrame([("s", *row)], FINDING)
    assert quality.vulnerability_errors(df).first()["errors"] == errors
    assert quality.vulnerability_gate(df).first()["passed"] == (not errors)


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", None, 0), ("", "9", 0), ("c", "5", 0)], "name string, version string, n int")
    after = spark.createDataFrame([("a", "2", 0), ("d", "1", 0), ("c", "6", 0)], "name string, version string, n int")
    got = {r["component"]: (r["before"], r["after"]) for r in keyed.snapshot_diff(before, after, "name", "version", ["n"]).collect()}
    assert got == {"b": ("", None), "c": ("5", "6"), "d": (None, "1")}


def test_read_json_records(spark, tmp_path):
    for name, body in {"ok": {"cases": [{"id": "x"}, {"id": "y"}]}, "none": {"cases": []}, "wrong": {"cases": {}}, "list": [1]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "cut.json").write_text('{"cases": [')
    got = tables.read_json_records(spark, str(tmp_path), "cases", "id STRING").collect()
    seen = sorted((r["path"].split("/")[-1], r["error"], r["id"]) for r in got if r["error"] is None)
    assert seen == [("ok.json", None, "x"), ("ok.json", None, "y")]
    assert sorted(r["path"].split("/")[-1] for r in got if r["error"]) == ["cut.json", "list.json", "wrong.json"]


def test_update_by_key_last_wins_and_does_not_insert(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "x", 1), (1, None, 2), (9, "z", 1)], "k int, v string, at int")
    got = {r["k"]: (r["v"], r["n"]) for r in tables.update_by_key(target, updates, ["k"], ["v"], ["at"]).collect()}
    assert got == {1: (None, 5), 2: ("b", 6)}


def test_confusion_of_empty_sides(spark):
    none = spark.createDataFrame([], "case_id string, dimension string, value string")
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    rows = evaluation.confusion_metrics(none, none, cases).collect()
    assert len(rows) == 9 and all((r["precision"], r["recall"], r["f1"], r["exact_match_rate"]) == (1, 1, 1, 1) for r in rows)
    found = spark.createDataFrame([("a", "sql", "x")], none.schema)
    row = evaluation.confusion_metrics(found, none, cases).where("dimension = 'sql'").first()
    assert (row["precision"], row["recall"], row["f1"], row["exact"]) == (0, 1, 0, 1)


RECORD = "provider string, model string, ai_request_count int, input_tokens long, output_tokens long, estimated_cost_usd double, parser_duration_ms double, ai_latency_ms double, total_duration_ms double, failure_count int, retry_count int"


def test_totals_of_nothing_are_zero(spark):
    row = evaluation.usage_totals(spark.createDataFrame([], RECORD)).first()
    assert (row["pipeline_count"], row["input_tokens"], row["estimated_cost_usd"], row["total_duration_ms"]) == (0, 0, 0, 0)


def test_one_unknown_makes_the_total_unknown(spark):
    rows = [("m", "d", 1, 5, None, 0.5, 1.0, 1.0, None, 0, 0), ("m", "d", 2, 6, 7, 0.25, 1.0, 1.0, 2.0, 0, 1)]
    df = spark.createDataFrame(rows, RECORD)
    row = evaluation.usage_totals(df).first()
    assert (row["input_tokens"], row["output_tokens"], row["estimated_cost_usd"], row["parser_duration_ms"]) == (11, None, 0.75, None)
    assert evaluation.project_usage(evaluation.usage_totals(df)).first()["estimated_cost_usd"] == 91.125


def checked(spark, rows):
    return spark.createDataFrame(rows, "case_id string, attempt int, body string, transport_error string, error string")


def test_resolve_attempts(spark):
    rows = [
        ("retry", 1, "x", None, "bad"), ("retry", 2, "ok", None, None),
        ("stop", 1, None, "timeout", "no"), ("stop", 2, "ok", None, None),
        ("late", 1, "x", None, "bad"), ("late", 2, "x", None, "worse"), ("late", 3, "ok", None, None),
    ]
    got = {r["case_id"]: tuple(r)[1:5] for r in results.resolve_attempts(checked(spark, rows)).collect()}
    assert got == {"retry": ("ai", 2, 1, None), "stop": ("fallback", 1, 0, "timeout"), "late": ("fallback", 2, 1, "worse")}
