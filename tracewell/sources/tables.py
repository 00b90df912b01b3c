"""Table input and output, row generation, record arrays and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.operators.keyed import dedupe_last, sole_by_key
from tracewell.scale import spread_join


def generate_rows(spark: SparkSession, n: int, fields: Mapping[str, tuple[Any, str]]) -> DataFrame:
    """``n`` copies of constant fields, given as name -> (value, type)."""
    return spark.range(n).select(*[F.lit(v).cast(t).alias(name) for name, (v, t) in fields.items()])


def table_input(
    spark: SparkSession,
    source: str,
    sql: str | None = None,
    params: Mapping[str, Any] | None = None,
    fmt: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a catalog table, or files or a database when ``fmt`` is given; with ``sql``, run it over ``source``.

    In ``sql`` the source is called ``{source}``; values enter as named parameters, never by text splicing.
    """
    if fmt:
        reader = spark.read.format(fmt).options(**dict(options or {}))
        rows = reader.load() if fmt == "jdbc" else reader.load(source)
    else:
        rows = spark.table(source)
    return spark.sql(sql, args=dict(params or {}), source=rows) if sql else rows


def table_output(
    df: DataFrame,
    target: str,
    mapping: Mapping[str, str],
    mode: str = "append",
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    as_path: bool = True,
) -> None:
    """Append rows under the target's column names; ``mapping`` is stream name -> column name."""
    writer = (
        df.select(*[F.col(a).alias(b) for a, b in mapping.items()])
        .write.mode(mode)
        .format(fmt)
        .options(**dict(options or {}))
    )
    if fmt == "jdbc":
        writer.option("dbtable", target).save()
    elif as_path:
        writer.save(target)
    else:
        writer.saveAsTable(target)


def update_by_key(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The target with ``values`` overwritten where all keys match; unmatched updates are not inserted.

    With ``order`` given, the last update of a key wins, as if they had been applied one by one. Without it, a key
    with two updates is an error.
    """
    if order:
        new = dedupe_last(updates.select(*keys, F.struct(*values).alias("_new"), *order), keys, order)
    else:
        new = sole_by_key(updates, keys, values)
    joined = spread_join(target, new.select(*keys, "_new"), keys, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
            if c in values
            else F.col(c)
            for c in target.columns
        ]
    )


def read_json_records(spark: SparkSession, path: str, array_field: str, record_schema: str) -> DataFrame:
    """Records of a JSON document's array, one row each; a document of another shape gives one row with ``error``."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return json_records(docs, "value", array_field, record_schema)


def json_records(docs: DataFrame, text: str, array_field: str, record_schema: str) -> DataFrame:
    """The same over a text column; other columns of ``docs`` are kept."""
    doc = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(F.try_variant_get("_doc", f"$.{array_field}", "variant"))
    parsed = docs.withColumn("_doc", doc).withColumn(
        "error",
        F.when(F.col("_doc").isNull(), "not JSON")
        .when(F.coalesce(~kind.startswith("ARRAY<"), F.lit(True)), f"no array named {array_field}"),
    )
    items = F.from_json(F.col(text), f"{array_field} ARRAY<STRUCT<{record_schema}>>")[array_field]
    kept = [c for c in docs.columns if c != text]
    return (
        parsed.select(*kept, "error", F.posexplode_outer(F.when(F.col("error").isNull(), items)).alias("position", "_r"))
        .where(F.col("error").isNotNull() | F.col("position").isNotNull())
        .select(*kept, "error", "position", "_r.*")
    )


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as JSON lines with keys in name order, nulls kept and text left as Unicode."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


