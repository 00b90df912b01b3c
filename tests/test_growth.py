"""What is counted, and into how many tasks rows go, does not hold work back as the input grows."""

import re

import pytest
from pyspark.sql import functions as F

from tracewell import scale
from tracewell.operators import results
from tracewell.plans import audit_queries, evaluation_queries
from tracewell.sources.artifacts import extract, route_artifacts

SF = "/root/testdata/sf0.001"


def test_group_sizes_are_bounded_by_buckets_and_exact_where_a_key_may_be_hot(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 500, -1).otherwise(F.col("id")).alias("k"))
    assert scale.largest_group(rows, ["k"], 100) == (500, 3000)
    largest, total = scale.largest_group(rows, ["k"], 1000)
    assert 500 <= largest <= 1000 and total == 3000
    assert scale.largest_group(rows, []) == (3000, 3000)
    assert scale.largest_group(rows.limit(0), ["k"]) == (0, 0)


def test_events_of_runs_are_not_computed_to_be_counted(spark, monkeypatch):
    counted = []

    def recorded(df, *args):
        counted.append(df._jdf.queryExecution().analyzed().toString())
        return taken(df, *args)

    taken = scale.largest_group
    for module in (scale, audit_queries):
        monkeypatch.setattr(module, "largest_group", recorded, raising=False)
    for name, passes in (("run_events", 1), ("event_sequence", 2)):
        counted.clear()
        audit_queries.QUERIES[name](spark, SF)
        assert len(counted) == passes and not any("Window" in plan for plan in counted)


def test_both_extractions_use_every_core(spark):
    plan = evaluation_queries.repeatability(spark, SF)._jdf.queryExecution().analyzed().toString()
    parts = {int(n) for n in re.findall(r"RepartitionByExpression \[(?:k|stem)#\d+L?\], (\d+)", plan)}
    assert len(parts) == 2 and min(parts) >= 2 * spark.sparkContext.defaultParallelism


def planned(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize(
    "queries, name, step",
    [
        (evaluation_queries, "analyze", "from_xml"), (evaluation_queries, "result_quality", "from_xml"),
        (evaluation_queries, "confusion_metrics", "min_by"),
    ],
)
def test_what_is_read_again_is_not_computed_again(spark, queries, name, step):
    assert step not in planned(queries.QUERIES[name](spark, SF))


def test_a_document_is_taken_apart_once(spark):
    plan = planned(evaluation_queries.QUERIES["export_context"](spark, SF))
    assert "get_json_object(context" not in plan and plan.count("json_tuple(context") == 1


def test_an_answer_is_written_as_text_and_searched_once(spark):
    body = '{"business_logic": [{"evidence_refs": ["ev-1", "ev-2"]}], "warnings": [{"evidence_refs": [["ev-3"]]}], "sql_explanations": [1]}'
    rows = spark.createDataFrame([("a", 1, body), ("b", 1, "no answer"), ("c", 1, None)], "case_id string, attempt int, body string")
    parsed = results.parse_results(rows)
    plan = planned(parsed)
    # Counting the keys is one search and taking the lists another.
    assert plan.count("StructsToJsonEvaluator") == 1 and plan.count("regexp_extract_all(") == 2
    got = {r.case_id: (r.cited, r.misshapen) for r in parsed.collect()}
    everything = ["sql_explanations", "source_target_interpretation", "dependency_summary"]
    assert got == {"a": (["ev-1", "ev-2", "(nested list)"], everything), "b": (None, everything), "c": (None, everything)}


def test_each_leaf_of_a_definition_is_cleaned_once(spark):
    files = spark.createDataFrame([("/a.ktr", "<transformation/>", "")], "path string, content string, source_sha256 string")
    plan = planned(extract(route_artifacts(files)), "analyzed")
    # One for each text leaf of the four formats, and one each for the types of JSON values; 112 and 14 with repeats.
    assert plan.count("btrim(") <= 66 and plan.count("schema_of_variant(") <= 9
