"""Rule checks, vulnerability gate, contract checks, corpus policy and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.scale import spread_join

# Severities that block, decisions that close a finding.
BLOCKING = ["MEDIUM", "HIGH", "CRITICAL"]
CLOSED = ["remediated", "not-applicable", "vendor-backport", "risk-accepted"]


def check_rules(df: DataFrame, rules: Sequence[tuple], key: str) -> DataFrame:
    """Violations as (rule, column, row_key, value).

    Rules: ("allowed", col, values), ("positive", col), ("not_null", col), ("max_length", col, n),
    ("unique", cols) and ("foreign_key", cols, other_table, other_cols). Row rules are tested in one pass. A
    violated unique rule gives one row per repeated key, with the number of rows as value.
    """
    row_rules, parts = [], []
    for rule, column, *rest in rules:
        if rule in ("unique", "foreign_key"):
            continue
        c = F.col(column)
        broken = {
            "allowed": lambda: ~c.isin(list(rest[0])),
            "positive": lambda: ~(c > 0),
            "not_null": lambda: c.isNull(),
            "max_length": lambda: F.char_length(c) > rest[0],
        }[rule]()
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), c.cast("string").alias("value"))
        row_rules.append(F.when(F.coalesce(broken, F.lit(False)), hit))
    if row_rules:
        found = df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.array_compact(F.array(*row_rules))).alias("v"))
        parts.append(found.select("v.rule", "v.column", "row_key", "v.value"))
    for rule, columns, *rest in rules:
        if rule == "unique":
            # Null keys are never equal to each other, so they cannot repeat.
            known = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
            repeated = df.where(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            parts.append(
                repeated.select(
                    F.lit(rule).alias("rule"),
                    F.lit(",".join(columns)).alias("column"),
                    F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("row_key"),
                    F.col("n").cast("string").alias("value"),
                )
            )
        elif rule == "foreign_key":
            other, other_columns = rest
            known = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
            present = other.select(*[F.col(o).alias(c) for o, c in zip(other_columns, columns)]).distinct()
            lost = spread_join(df.where(known).select(F.col(key).cast("string").alias("row_key"), *columns), present, columns, "left_anti")
            parts.append(
                lost.select(
                    F.lit(rule).alias("rule"),
                    F.lit(",".join(columns)).alias("column"),
                    "row_key",
                    F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def vulnerability_errors(findings: DataFrame) -> DataFrame:
    """Policy errors of each finding; a finding may have several."""

    def or_else(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    fid, severity = or_else("id", "unknown"), F.upper(F.coalesce("severity", F.lit("")))
    applicability, decision = or_else("applicability", "unknown"), or_else("decision", "open")
    applies = severity.isin(BLOCKING) & (applicability == "applicable")
    no_evidence = F.coalesce(F.size("evidence"), F.lit(0)) <= 0

    def error(when: Column, *text) -> Column:
        return F.when(when, F.concat(fid, *[F.lit(t) if isinstance(t, str) else t for t in text]))

    rules = F.array(
        error(applies & ~decision.isin(CLOSED), ": applicable ", severity, " vulnerability is still open"),
        error(applies & (decision == "risk-accepted") & blank("approval_reference"), ": risk acceptance requires approval_reference"),
        error(applies & (decision == "remediated") & blank("fixed_version"), ": remediation requires fixed_version"),
        error((applicability == "not-applicable") & no_evidence, ": not-applicable decision requires evidence"),
        error((decision == "vendor-backport") & blank("vendor_advisory"), ": vendor-backport requires vendor_advisory"),
        error(blank("asset_type"), ": asset_type is required"),
    )
    return findings.select("scan_id", "id", F.array_compact(rules).alias("errors"))


def vulnerability_gate(findings: DataFrame) -> DataFrame:
    """Per scan: findings, errors, and whether the scan passes, which takes no error at all."""
    errors = F.sum(F.size("errors"))
    return vulnerability_errors(findings).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings"), errors.alias("errors"), (errors == 0).alias("passed")
    )


#: Names of JSON types and the beginnings of the VARIANT types that they are.
JSON_TYPES = {
    "boolean": ["BOOLEAN"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "integer": ["BIGINT"], "string": ["STRING"],
    "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"],
}


def _json_type(value) -> str:
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}
    if type(value) not in kinds:
        raise TypeError(f"not a JSON scalar: {value!r}")
    return kinds[type(value)]


def check_contract(df: DataFrame, json_col: str, contract: Mapping) -> DataFrame:
    """Contract errors of a JSON text column, as an array column ``contract_errors``.

    ``contract`` may hold required (names), types (name -> JSON type), constants (name -> value), enums (name -> values),
    closed (all allowed names) and lengths (name -> characters of a string). Names may be dotted paths, except in
    ``closed``. Values are compared with their type: ``true``, 1 and "1" are three values, 1 and 1.0 are one.
    """
    text = F.col(json_col)
    doc = F.try_parse_json(text)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))

    def at(name: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", "variant")

    def has(name: str) -> Column:
        return at(name).isNotNull()

    def is_type(value: Column, kind: str) -> Column:
        found = F.schema_of_variant(value)
        return F.coalesce(F.array_contains(F.array(*[F.lit(k) for k in JSON_TYPES[kind]]), F.regexp_extract(found, "^[A-Z]+", 0)), F.lit(False))

    def equals(name: str, value) -> Column:
        kind = _json_type(value)
        if kind == "null":
            return is_type(at(name), kind)
        as_type = {"boolean": "boolean", "number": "double", "string": "string"}[kind]
        same = F.try_variant_get(doc, f"$.{name}", as_type) == F.lit(value).cast(as_type)
        return is_type(at(name), kind) & F.coalesce(same, F.lit(False))

    def among(name: str, values) -> Column:
        return reduce(Column.__or__, [equals(name, v) for v in values], F.lit(False))

    def wrong_length(name: str, length: int) -> Column:
        size = F.char_length(F.try_variant_get(doc, f"$.{name}", "string"))
        return ~(is_type(at(name), "string") & F.coalesce(size == length, F.lit(False)))

    rules = [
        ("required", None, lambda n, _: ~has(n), "missing"),
        ("types", has, lambda n, kind: ~is_type(at(n), kind), "type of"),
        ("constants", has, lambda n, v: ~equals(n, v), "wrong"),
        ("enums", has, lambda n, values: ~among(n, values), "unknown"),
        ("lengths", has, wrong_length, "length of"),
    ]
    tests = []
    for rule, where, broken, says in rules:
        named = contract.get(rule, {})
        for n, v in named.items() if isinstance(named, Mapping) else ((n, None) for n in named):
            test = broken(n, v)
            tests.append(F.when(where(n) & test if where else test, F.lit(f"{says} {n}")))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    if "closed" in contract:
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in contract["closed"]]))
        found = F.concat(found, F.transform(F.sort_array(extra), lambda k: F.concat(F.lit("extra "), k)))
    errors = F.when(doc.isNull(), F.array(F.lit("not JSON"))).when(~is_type(doc, "object"), F.array(F.lit("not an object"))).otherwise(found)
    return df.withColumn("contract_errors", errors)


def scan_tokens(docs: DataFrame, text: str, tokens: Sequence[str]) -> DataFrame:
    """Documents that hold a forbidden token, with the character position of its first occurrence."""
    listed = F.array(*[F.lit(t) for t in tokens])
    hits = F.filter(listed, lambda t: F.contains(F.col(text), t))
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, text, F.explode(hits).alias("token")).select(
        *kept, "token", F.instr(F.col(text), F.col("token")).alias("at")
    )


def require_markers(docs: DataFrame, text: str, markers: Sequence[str]) -> DataFrame:
    """Documents that lack a required marker text."""
    listed = F.array(*[F.lit(m) for m in markers])
    lacking = F.filter(listed, lambda m: ~F.coalesce(F.contains(F.col(text), m), F.lit(False)))
    return docs.select(*[c for c in docs.columns if c != text], F.explode(lacking).alias("missing_marker"))


def build_manifest(files: DataFrame) -> DataFrame:
    """Path and SHA-256 of each file's bytes."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against the manifest."""
    now = build_manifest(files).withColumnRenamed("sha256", "actual")
    then = manifest.select("path", F.col("sha256").alias("expected"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    joined = now.join(then, "path", "full").where(~F.col("actual").eqNullSafe(F.col("expected")))
    return joined.select("path", state.alias("state"))
