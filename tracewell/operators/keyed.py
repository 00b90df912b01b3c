"""Numbering, first/last per key, snapshot and set comparison, reference checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.scale import running, spread_join


def add_sequence(
    df: DataFrame,
    order: Sequence[str],
    name: str = "seq",
    start: int = 1,
    step: int = 1,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Number rows ``start + (n - 1) * step`` in a total ``order``, over the whole table or per key."""
    ranked = running(df, partition_by, order, {name: ("row_number",)})
    return ranked.withColumn(name, (F.lit(start) + (F.col(name) - 1) * F.lit(step)).cast("long"))


def assign_ordinals(
    df: DataFrame, prefix: str, order: Sequence[str], name: str = "id", key: str = "artifact_id"
) -> DataFrame:
    """Ids such as ``ev-0001`` per artifact in a total ``order``."""
    numbered = add_sequence(df, order, name, partition_by=[key])
    return numbered.withColumn(name, ordinal(prefix, F.col(name)))


def ordinal(prefix: str, number: Column) -> Column:
    """At least four digits, more when the number is longer."""
    return F.format_string(f"{prefix}-%04d", number.cast("long"))


def _per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key; combined map-side, so repeats of a key never meet in one task."""
    return _per_key(df, keys, order, F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of each key."""
    return _per_key(df, keys, order, F.max_by)


def snapshot_diff(
    before: DataFrame, after: DataFrame, key: str, value: str, order: Sequence[str] = ()
) -> DataFrame:
    """Components whose value changed, appeared or vanished.

    Blank keys are skipped; a missing value is "" and differs from an absent component; with ``order`` the last
    row of a repeated key counts.
    """

    def clean(df: DataFrame, out: str) -> DataFrame:
        named = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        rows = named.select(F.col(key).alias("component"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias(out), *order)
        return (dedupe_last(rows, ["component"], order) if order else rows).select("component", out)

    both = clean(before, "before").join(clean(after, "after"), "component", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def unknown_refs(claims: DataFrame, allowed: DataFrame, case: str = "case_id", refs: str = "refs") -> DataFrame:
    """Cited ids that the case's allowed set does not hold; ``allowed`` has the case and ``ref``."""
    cited = claims.select(case, F.explode(refs).alias("ref")).distinct()
    return cited.join(allowed.select(case, "ref").distinct(), [case, "ref"], "left_anti")


def missing_required(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required keys that are not present."""
    return required.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def set_compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct key with the side it belongs to: both, left or right."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right")
    return left.join(right, list(keys), "full").select(*keys, side.alias("side"))


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either side, once."""
    return a.unionByName(b).distinct()


def is_subset(a: DataFrame, b: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group of ``a``: how many distinct keys are absent from ``b``, and whether none is."""
    on = [*group, *keys]
    inside = b.select(*on).distinct().withColumn("_in", F.lit(True))
    checked = a.select(*on).distinct().join(inside, on, "left")
    missing = F.count_if(F.col("_in").isNull())
    return checked.groupBy(*group).agg(missing.alias("missing"), (missing == 0).alias("is_subset"))


def same_multiset(a: DataFrame, b: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group of either side: whether both hold each key equally often."""
    on = [*group, *keys]
    left = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_na"))
    right = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_nb"))
    differs = F.count_if(~F.col("_na").eqNullSafe(F.col("_nb")))
    return (
        left.join(right, on, "full")
        .groupBy(*group)
        .agg(differs.alias("differing"), (differs == 0).alias("same_multiset"))
    )


def lookup(df: DataFrame, ref: DataFrame, on: Sequence[str], values: dict[str, object], order: Sequence[str]) -> DataFrame:
    """Enrich by key with at most one match; ``values`` maps each looked-up column to its default or None.

    The first reference row of a key by ``order`` is used. Rows without a match are kept.
    """
    one = dedupe_first(ref.select(*on, *dict.fromkeys([*values, *order])), on, order).select(*on, *values)
    joined = spread_join(df, one.withColumn("_hit", F.lit(True)), on, "left")
    fills = {
        c: F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(d)) for c, d in values.items() if d is not None
    }
    return joined.withColumns(fills).drop("_hit") if fills else joined.drop("_hit")


def sole_by_key(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys and ``_new``, the struct of their values; rows with a null key match nothing and go.

    A key that occurs twice raises when its values are read, since neither row could be said to win.
    """
    found = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.any_value(F.struct(*values)).alias("_one"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit("key occurs more than once: "), F.to_json(F.struct(*keys))))
    return found.select(*keys, F.when(F.col("_n") == 1, F.col("_one")).otherwise(twice).alias("_new"))
