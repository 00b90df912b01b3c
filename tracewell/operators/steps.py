"""The step vocabulary: filter, calculate, select, variables, joins, group-by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import expand_template


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


def calculate(df: DataFrame, exprs: Mapping[str, Column | str]) -> DataFrame:
    """Add derived columns."""
    return df.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()})


def select_values(df: DataFrame, spec: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Keep, rename and retype: name -> (new name, new type or None)."""
    return df.select(*[(F.col(c).cast(t) if t else F.col(c)).alias(n) for c, (n, t) in spec.items()])


def group_by(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def resolve_parameters(
    df: DataFrame, fields: Mapping[str, tuple[str, str]], declared: Mapping[str, Any], run_values: Mapping[str, Any]
) -> DataFrame:
    """Add typed run-context columns, name -> (template, type); run values come first, declared defaults second."""
    values = {**declared, **run_values}
    if values:
        params = F.create_map(*[F.lit(str(x)) for kv in values.items() for x in kv])
    else:
        params = F.lit(None).cast("map<string,string>")
    return df.withColumns(
        {
            n: F.coalesce(expand_template(F.lit(template), params), F.lit(template)).cast(t)
            for n, (template, t) in fields.items()
        }
    )


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Sort-merge equi join: inner, left, right or full.

    Adaptive execution splits skewed partitions of all but full joins, so a full join is put together from a left
    join and the right rows that found no partner.
    """
    on = list(on)
    if how != "full":
        return left.hint("merge").join(right, on, how)
    matched = left.hint("merge").join(right, on, "left")
    alone = right.join(left.select(*on).hint("merge"), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def join_rows(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Rows of both sides that share ``on`` and meet a further condition such as a range.

    Equal columns are required: a bare product of two tables is not offered.
    """
    on = list(on)
    if not on:
        raise ValueError("join_rows needs at least one equal column")
    return left.join(right, on, "inner").where(condition)
