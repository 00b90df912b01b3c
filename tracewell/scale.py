"""Joins and ordered windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tracewell.session import written

HOT_ROWS = 2_000_000
COUNT_BUCKETS = 1 << 16


def _row_hash(df: DataFrame) -> Column:
    """Hash of every column Spark can hash; stable over task retries, unlike a random salt."""
    plain = [
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def largest_group(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[int, int]:
    """Rows of the biggest key and rows in all; a bound on the former while no key can have over ``hot_rows`` rows.

    Rows are first counted by a hash of the key, of which a task sends on at most ``COUNT_BUCKETS`` counts, however
    many keys there are. Where no bucket is over the limit no key is. Only else the keys themselves are counted.
    """

    def counted(*by) -> tuple[int, int]:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
        return int(row["largest"] or 0), int(row["total"] or 0)

    if not keys:
        return counted()
    bound = counted(F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS)).alias("bucket"))
    return bound if bound[0] <= hot_rows else counted(*keys)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    sized_by: tuple[DataFrame, Sequence[str], int] | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Equi join in which ``right`` holds each key at most once and hot keys of ``left`` are split.

    The keys of ``left`` are counted first. When none is hot this is a plain join. Where ``left`` is costly to
    compute, ``sizes`` may hand over counts taken before, or ``sized_by`` may name a cheaper table, coarser keys and the left rows expected per row of it; only
    when that table shows a key that could be hot is ``left`` itself counted. Otherwise left rows of a hot
    key go to several partitions by row hash, and only the matching right rows are copied. At most rows/hot_rows
    keys can be hot, which bounds the table that is broadcast to mark them. Rows with a null key never match and
    are spread as well, so that they do not pile up in one task.
    """
    on = list(on)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot split the left side of a {how} join")
    if sized_by is not None:
        table, keys, fanout = sized_by
        if largest_group(table, keys, hot_rows // fanout)[0] * fanout <= hot_rows:
            return left.join(right, on, how)
    if (sizes or largest_group(left, on, hot_rows))[0] <= hot_rows:
        return left.join(right, on, how)
    hot = F.broadcast(
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    )
    any_null = F.lit(False)
    for c in on:
        any_null = any_null | F.col(c).isNull()
    salt = (
        F.when(any_null, F.pmod(_row_hash(left), F.lit(1024)))
        .when(F.col("_parts").isNotNull(), F.pmod(_row_hash(left), F.col("_parts")))
        .otherwise(F.lit(0))
        .cast("int")
    )
    salted = left.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return salted.join(copied, on + ["_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple],
    hot_rows: int = HOT_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Ordered running values per key, without ever putting a very large key into one task.

    ``outputs`` maps a new column to ``("row_number",)``, ``("max", col)`` or ``("lag", col)``, all in ascending
    ``order``, which must order the rows of a key totally. Without ``keys`` the whole table is one key.

    Key sizes are counted first, unless ``sizes`` hands them over. When every key fits a task this is a plain window. Otherwise the rows are range
    partitioned by key and order and written once, so that all later reads see the same cuts; values are computed
    inside a cut, and a table with one row per key and cut carries them from one cut to the next.
    """
    keys, order = list(keys), list(order)
    largest, total = sizes or largest_group(df, keys, hot_rows)
    if largest <= hot_rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        exprs = {
            "row_number": lambda: F.row_number().over(window).cast("long"),
            "max": lambda c: F.max(c).over(so_far),
            "lag": lambda c: F.lag(c).over(window),
        }
        return df.withColumns({name: exprs[spec[0]](*spec[1:]) for name, spec in outputs.items()})

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // hot_rows + 1)
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_cut", F.spark_partition_id())
    base = written(ranged, "ranged")

    inside = Window.partitionBy(*keys, "_cut").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_cut")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carries, finals = {"_nth": F.row_number().over(inside)}, [], {}, {}
    for name, spec in outputs.items():
        kind, here, total_of, carry = spec[0], f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if kind == "row_number":
            totals.append(F.count(F.lit(1)).alias(total_of))
            carries[carry] = F.sum(total_of).over(earlier)
            finals[name] = (F.col("_nth") + F.coalesce(F.col(carry), F.lit(0))).cast("long")
        elif kind == "max":
            local[here] = F.max(spec[1]).over(so_far)
            totals.append(F.max(spec[1]).alias(total_of))
            carries[carry] = F.max(total_of).over(earlier)
            finals[name] = F.greatest(F.col(here), F.col(carry))
        elif kind == "lag":
            local[here] = F.lag(spec[1]).over(inside)
            totals.append(F.max_by(F.struct(spec[1]), F.struct(*order)).alias(total_of))
            carries[carry] = F.lag(total_of).over(across)
            finals[name] = F.when(F.col("_nth") == 1, F.col(carry)[spec[1]]).otherwise(F.col(here))
        else:
            raise ValueError(f"unknown running value: {kind}")

    carried = base.groupBy(*keys, "_cut").agg(*totals).withColumns(carries).select(*keys, "_cut", *carries)
    match = F.lit(True)
    for c in [*keys, "_cut"]:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = base.withColumns(local).alias("a").join(carried.alias("b"), match, "left")
    return joined.select(
        *[F.col(f"a.`{c}`") for c in df.columns], *[expr.alias(name) for name, expr in finals.items()]
    )


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, weight: str | None = None
) -> DataFrame:
    """Exact interpolated percentile per key, with no task holding all values of a key.

    Values are first counted per (key, value), where ``weight`` says how often a row counts. A logarithmic bucket
    of the value, of which there are at most a few thousand, tells where the wanted rank lies; only the bucket or
    two around it are then ordered.
    """
    keys = list(keys)
    magnitude = F.floor(F.log2(F.abs(F.col("_v")) + 1) * 8)
    bucket = F.when(F.col("_v") < 0, -magnitude - 1).otherwise(magnitude)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_b", bucket)
    )
    ordered = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumns(
            {
                "_start": F.coalesce(F.sum("_bn").over(ordered), F.lit(0)),
                "_total": F.sum("_bn").over(Window.partitionBy(*keys)),
            }
        )
        .withColumn("_pos", F.lit(float(q)) * (F.col("_total") - 1))
        .where((F.col("_start") <= F.ceil("_pos")) & (F.col("_start") + F.col("_bn") > F.floor("_pos")))
        .select(*keys, "_b", "_start", "_pos")
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(wanted, keys + ["_b"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(within))
    return (
        near.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v"))).alias("_lo"),
            F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v"))).alias("_hi"),
            F.first("_pos").alias("_pos"),
        )
        .select(
            *keys,
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias(out),
        )
    )
