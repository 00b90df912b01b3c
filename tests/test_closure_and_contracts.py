"""Reachability by doubled paths, digests of nested rows, and contracts that tell JSON types apart."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import lineage, quality


def edges(spark, rows):
    return spark.createDataFrame(rows, "artifact_id string, from_id string, to_id string")


def starts(spark, rows):
    return spark.createDataFrame(rows, "artifact_id string, step_id string")


def test_long_chain_takes_few_rounds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "work_path", lambda spark, name: str(tmp_path / name))
    chain = edges(spark, [("a", f"s{i}", f"s{i + 1}") for i in range(5000)])
    found = lineage.reachable_pairs(chain, starts(spark, [("a", "s0"), ("a", "s4990"), ("b", "s0")]))
    assert {(r.artifact_id, r.start): r["count"] for r in found.groupBy("artifact_id", "start").count().collect()} == {("a", "s0"): 5001, ("a", "s4990"): 11, ("b", "s0"): 1}
    assert len(list(Path(tmp_path / "reachable").glob("found=*"))) <= 15


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = {(a, f"s{rng.randrange(12)}", f"s{rng.randrange(12)}") for a in "ab" for _ in range(14)}
    begin = [("a", "s0"), ("a", "s1"), ("b", "s2"), ("b", "zz"), ("b", None)]
    want = set()
    for a, s in begin:
        seen, left = set(), [s] if s else []
        while left:
            n = left.pop()
            if n not in seen:
                seen.add(n)
                left += [t for x, f, t in rows if (x, f) == (a, n)]
        want |= {(a, s, n) for n in seen}
    got = lineage.reachable_pairs(edges(spark, [*rows, ("a", None, "s1"), ("a", "s1", None)]), starts(spark, begin + begin))
    found = [tuple(r) for r in got.select("artifact_id", "start", "node").collect()]
    assert set(found) == want and len(found) == len(want)
    assert lineage.reachable_pairs(edges(spark, []), starts(spark, [])).count() == 0


def test_equal_nested_values_have_one_digest(spark):
    rows = spark.sql(
        """SELECT 1 AS id, map('a', 1, 'b', 2) AS m, named_struct('y', array(map('k', 1, 'j', 2)), 'x', 1) AS s, parse_json('{"q": 1, "p": [2]}') AS v
        UNION ALL SELECT 1, map('b', 2, 'a', 1), named_struct('y', array(map('j', 2, 'k', 1)), 'x', 1), parse_json('{"p": [2], "q": 1}')
        UNION ALL SELECT 1, map('b', 1, 'a', 2), named_struct('y', array(map('j', 2, 'k', 1)), 'x', 1), parse_json('{"p": [2], "q": 1}')
        UNION ALL SELECT 1, NULL, NULL, NULL UNION ALL SELECT 1, map(), named_struct('y', CAST(NULL AS ARRAY<MAP<STRING, INT>>), 'x', NULL), NULL"""
    )
    digests = [r[0] for r in rows.select(text.record_digest(rows.columns, rows.schema)).collect()]
    assert digests[0] == digests[1] and len(set(digests)) == 4
    renamed = rows.selectExpr("v", "named_struct('x', s.x, 'y', s.y) AS s", "id", "m")
    again = [r[0] for r in renamed.select(text.record_digest(renamed.columns, renamed.schema)).collect()]
    assert again[:3] == digests[:3]


CASES = {
    '{"a": true}': [], '{"a": "true"}': ["wrong a"], '{"a": 1}': ["wrong a"], '{"a": null}': ["wrong a"], "{}": ["missing a"],
    '{"a": true, "n": 1}': [], '{"a": true, "n": 1.0}': [], '{"a": true, "n": "1"}': ["wrong n"], '{"a": true, "n": true}': ["wrong n"],
    '{"a": true, "n": 1.5}': ["wrong n"], '{"a": true, "e": "1"}': [], '{"a": true, "e": 1}': ["unknown e"], '{"a": true, "e": false}': [],
    '{"a": true, "e": null}': [], '{"a": true, "e": [1]}': ["unknown e"], '{"a": true, "t": []}': [], '{"a": true, "t": {}}': ["type of t"],
    '{"a": true, "o": {"p": "xyz"}}': [], '{"a": true, "o": {"p": 123}}': ["length of o.p"], '{"a": true, "z": 0}': ["extra z"],
    "[true]": ["not an object"], "true": ["not an object"], "{": ["not JSON"], '{"a": true, "i": 1}': [], '{"a": true, "i": 1.5}': ["type of i"],
}


def test_types_are_told_apart(spark):
    contract = {
        "required": ["a"], "constants": {"a": True, "n": 1}, "enums": {"e": ["1", False, None]}, "types": {"t": "array", "i": "integer"},
        "lengths": {"o.p": 3}, "closed": ["a", "n", "e", "t", "o", "i"],
    }
    docs = spark.createDataFrame([(d,) for d in CASES] + [(None,)], "doc string")
    got = {r.doc: r.contract_errors for r in quality.check_contract(docs, "doc", contract).collect()}
    assert got.pop(None) == ["not JSON"] and got == CASES
    with pytest.raises(TypeError, match="scalar"):
        quality.check_contract(docs, "doc", {"constants": {"a": F.lit(1)}})
