"""Text clean-up, digests, redaction and response decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Marks put in place of hidden text, the key pattern, the literal and table patterns.
REDACTED = "[REDACTED]"
REDACTED_LITERAL = "'[REDACTED_LITERAL]'"
SENSITIVE_KEY = r"(?i)(password|passwd|secret|token|api[_-]?key|credential|private[_-]?key)"
SQL_LITERAL = r"'[^']*+'"
SQL_TABLE = r"(?i)\b(?:from|join)\s+([A-Za-z0-9_$\{\}.]+)"
ERROR_LIMIT = 1000

WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def redact_sql_literals(text: Column) -> Column:
    """Replace each quoted SQL string; a doubled quote stays inside its string.

    A string with doubled quotes is a run of plain ones: each part is emptied, then the run is replaced. Neither
    pattern recurses, however long the text; a last quote without an end stays.
    """
    return F.regexp_replace(F.regexp_replace(text, SQL_LITERAL, "''"), "(?:'')++", REDACTED_LITERAL)


def sql_digest(text: Column) -> Column:
    """SHA-256 of the statement with white space collapsed and letters lowered."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _ANY_SPACE, " "))
    return F.sha2(F.lower(flat), 256)


def sql_tables(text: Column) -> Column:
    """Names that follow FROM or JOIN, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(SQL_TABLE), 1)


def strip_code_fence(text: Column) -> Column:
    """Drop the first and last line of a text that is wrapped in a code fence."""
    bare = strip_space(text)
    fenced = bare.startswith("```") & bare.endswith("```")
    lines = F.regexp_replace(bare, r"\r\n?", "\n")
    return F.when(fenced, strip_space(F.regexp_extract(lines, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1))).otherwise(bare)


def error_summary(text: Column, limit: int = ERROR_LIMIT) -> Column:
    """The message as stored in the log."""
    return F.left(text, F.lit(limit))


def message_or(text: Column, default: str) -> Column:
    """The message, or a default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def qualified_name(schema: Column, table: Column) -> Column:
    """Schema and table joined by a dot, leaving out empty parts."""
    return F.concat_ws(".", F.nullif(schema, F.lit("")), F.nullif(table, F.lit("")))


def uniq_refs(refs: Column) -> Column:
    """The references without blanks and repeats, first appearance first."""
    return F.array_distinct(F.filter(refs, lambda r: r.isNotNull() & (r != "")))


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def canonical(value: Column, dtype: T.DataType) -> Column:
    """The same value in one form, whatever order its parts were written in: struct fields in name order, maps as arrays
    of entries in key order, at any depth. The parts of VARIANT objects are in name order by themselves."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), canonical(F.element_at(value, k), dtype.valueType).alias("value")))
    return value


def record_digest(cols: Sequence[str], schema: T.StructType | None = None) -> Column:
    """SHA-256 of the row as JSON with columns in name order and nulls kept.

    With the table's ``schema``, nested values count in canonical form, so that equal maps have equal digests.
    """
    ordered = F.struct(*[(canonical(F.col(f"`{c}`"), schema[c].dataType) if schema else F.col(c)).alias(c) for c in sorted(cols)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def expand_template(text: Column, params: Column) -> Column:
    """Replace every ``${NAME}`` by the value of NAME in the map column ``params``; unknown names stay."""
    mark = F.lit("${")
    return F.aggregate(
        F.map_entries(params),
        text,
        lambda acc, e: F.replace(acc, F.concat(mark, e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))),
    )


def decode_responses(df: DataFrame, column: str) -> DataFrame:
    """Decode a response text as JSON, else as XML with result, message and id, else keep it raw.

    Adds ``decoded_as`` (json / xml / raw), ``result``, ``message``, ``id`` and ``raw``.
    """
    schema = "result STRING, message STRING, id STRING, _bad STRING"
    text = F.col(column)
    looked = df.withColumns(
        {
            "_json": F.try_parse_json(text),
            "_xml": F.when(
                F.trim(text).startswith("<"),
                F.from_xml(text, schema, {"columnNameOfCorruptRecord": "_bad", "ignoreSurroundingSpaces": "false"}),
            ),
        }
    )
    is_json = F.col("_json").isNotNull()
    is_xml = ~is_json & F.col("_xml").isNotNull() & F.col("_xml._bad").isNull()
    return looked.withColumns(
        {
            "decoded_as": F.when(is_json, "json").when(is_xml, "xml").otherwise("raw"),
            **{
                name: F.when(is_json, F.try_variant_get("_json", f"$.{name}", "string")).when(
                    is_xml, F.col(f"_xml.{name}")
                )
                for name in ("result", "message", "id")
            },
            "raw": F.when(~is_json & ~is_xml, text),
        }
    ).drop("_json", "_xml")


def redact_keys(df: DataFrame) -> DataFrame:
    """Hide every column, struct field, map entry or VARIANT key whose name looks like a secret, at any depth.

    Maps with text keys come back with text values (nested values as JSON), so that the mark fits.
    """
    secret = re.compile(SENSITIVE_KEY)

    def as_text(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(rebuild(value, dtype))
        return value if isinstance(dtype, T.StringType) else value.cast("string")

    def rebuild(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            parts = [field(value[f.name], f).alias(f.name) for f in dtype.fields]
            return F.when(value.isNotNull(), F.struct(*parts))
        if isinstance(dtype, T.VariantType):
            return F.parse_json(redact_keys_json(F.to_json(value)))
        if "variant" in dtype.simpleString():
            return F.from_json(redact_keys_json(F.to_json(value)), dtype)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda v: rebuild(v, dtype.elementType))
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            shown = lambda k, v: F.when(k.rlike(SENSITIVE_KEY), REDACTED).otherwise(as_text(v, dtype.valueType))
            return F.transform_values(value, shown)
        if isinstance(dtype, T.MapType):
            return F.transform_values(value, lambda k, v: rebuild(v, dtype.valueType))
        return value

    def field(value: Column, f: T.StructField) -> Column:
        return F.lit(REDACTED) if secret.search(f.name) else rebuild(value, f.dataType)

    return df.select(*[field(F.col(f"`{f.name}`"), f).alias(f.name) for f in df.schema.fields])


@F.pandas_udf(T.StringType())
def redact_keys_json(texts: pd.Series) -> pd.Series:
    """Hide values under secret-looking keys in free-form JSON text; Arrow batches, text that is no JSON is null."""
    secret = re.compile(SENSITIVE_KEY)

    def hide(value):
        if isinstance(value, dict):
            return {k: REDACTED if secret.search(k) else hide(v) for k, v in value.items()}
        if isinstance(value, list):
            return [hide(v) for v in value]
        return value

    def one(text):
        try:
            return None if text is None else json.dumps(hide(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)
