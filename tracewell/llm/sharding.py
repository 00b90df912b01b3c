"""Shards of near equal bytes by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.scale import running
from tracewell.session import written

STEP_BITS, COORDINATE_BITS = 12, 24
SLOT_ROWS = 500_000


def _crossing(rows: DataFrame, key: str, targets: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """Per node the value of ``key`` (0 to 2**48 - 1) at which the bytes up to it pass the target, the bytes below it
    and its own. Four counting passes of 12 bits each; only one row per node reaches the driver.
    """
    found = {n: (0, 0, 0) for n in targets}
    for shift in range(48 - STEP_BITS, -1, -STEP_BITS):
        prefix = _choose({n: found[n][0] for n in targets})
        near = rows.where(F.shiftright(key, shift + STEP_BITS) == prefix) if shift + STEP_BITS < 48 else rows.where(prefix.isNotNull())
        bins = near.groupBy("node", F.shiftright(key, shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")) + _choose({n: found[n][1] for n in targets})
        passing = bins.withColumn("upto", upto).where(F.col("upto") * _choose({n: t[1] for n, t in targets.items()}) >= _choose({n: t[0] for n, t in targets.items()}))
        for r in passing.groupBy("node").agg(F.min(F.struct("bin", "upto", "bytes")).alias("x")).collect():
            found[r["node"]] = (r["x"]["bin"], r["x"]["upto"] - r["x"]["bytes"], r["x"]["bytes"])
    return found


def _choose(by_node: dict[int, int]) -> Column:
    """A column with each node's own number; nodes number fewer than twice the shards."""
    out = F.lit(None).cast("long")
    for n, v in by_node.items():
        out = F.when(F.col("node") == n, F.lit(v).cast("long")).otherwise(out)
    return out


def _halves(shards: tuple[int, int]) -> tuple[int, int]:
    middle = shards[0] + (shards[1] - shards[0]) // 2
    return middle, shards[1] - shards[0]


def kd_shards(docs: DataFrame, shards: int, dimensions: list[str], size: str, group: str, id_col: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (0 to shards - 1) and ``slot``: shards hold near equal sums of ``size``.

    ``docs`` should hold ids and metadata only; all its columns travel. ``dimensions`` name numeric metadata columns
    (null counts as 0), each taken over the range it has in the whole table. From the root down a node is cut along
    its widest dimension, at the weighted median (or the quantile that its share of the shards asks for), until each
    leaf is one shard, whose share of the bytes is the target. Rows with an equal value of ``group`` stand at the
    place of the group's first row. They are cut apart only if a cut beside the whole group would miss its target by
    more than ``tolerance`` of a shard, as with a group larger than a shard; the cut then follows a hash of
    ``id_col``. Slots number a shard's rows from 0 without gaps, in order of ``id_col``, nulls first. Repeated rows
    and null ids are placed like any others; columns named ``shard`` or ``slot`` are replaced.

    Only compact rows move: one aggregation and one join by group, then counting passes over a written table, five
    levels for 24 shards. No node's rows ever meet in one task, and one row per node is collected.
    """
    before = [c for c in docs.columns if c not in ("shard", "slot")]
    names = [f"_d{i}" for i in range(len(dimensions))]
    spot = {n: F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for n, d in zip(names, dimensions, strict=True)}
    rows = docs.withColumns({"_g": F.xxhash64(group), "_size": F.col(size).cast("long"), "_id": F.col(id_col).cast("long")})
    first = F.min_by(F.struct(*[c.alias(n) for n, c in spot.items()]), F.struct("_id", *spot.values()))
    places = written(rows.groupBy("_g").agg(first.alias("at")), "kd_groups")
    limits = places.agg(*[f(f"at.{n}").alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()

    def place(n: str) -> Column:
        low, high = limits[f"{n}_lo"] or 0.0, limits[f"{n}_hi"] or 0.0
        share = F.floor((F.col(f"at.{n}") - F.lit(low)) / F.lit((high - low) or 1.0) * ((1 << COORDINATE_BITS) - 1))
        return F.shiftleft(share, 48 - COORDINATE_BITS) + F.pmod(F.xxhash64("_g"), F.lit(1 << (48 - COORDINATE_BITS)))

    placed = places.select("_g", *[place(n).alias(n) for n in names])
    points = written(rows.join(placed, "_g").withColumn("_order", F.pmod(F.xxhash64("_id"), F.lit(1 << 48))), "kd_points")
    compact = points.select(*names, "_order", F.col("_size").alias("size"))
    slack = tolerance * (compact.agg(F.sum("size")).first()[0] or 0) / shards

    nodes, cuts = {1: (0, shards)}, {}

    def leaf(n: int = 1) -> Column:
        if n not in cuts:
            return F.lit(n)
        dimension, value, inner = cuts[n]
        key = F.col(dimension)
        right = key >= value if inner is None else (key > value) | ((key == value) & (F.col("_order") >= inner))
        return F.when(right, leaf(2 * n + 1)).otherwise(leaf(2 * n))

    while wide := {n: s for n, s in nodes.items() if s[1] - s[0] > 1}:
        current = compact.withColumn("node", leaf()).where(F.col("node").isin(list(wide)))
        spans = [(F.max(n) - F.min(n)).alias(n) for n in names]
        shape = {r["node"]: r for r in current.groupBy("node").agg(F.sum("size").alias("bytes"), *spans).collect()}
        widest = {n: max(names, key=lambda d, r=r: r[d]) for n, r in shape.items()}
        along = F.lit(None).cast("long")
        for n, d in widest.items():
            along = F.when(F.col("node") == n, F.col(d)).otherwise(along)
        current = current.withColumn("key", along)
        targets = {n: (r["bytes"] * (_halves(wide[n])[0] - wide[n][0]), _halves(wide[n])[1]) for n, r in shape.items()}
        torn = {}
        for n, (value, below, own) in _crossing(current, "key", targets).items():
            wanted = targets[n][0] / targets[n][1]
            errors = {value: abs(wanted - below), value + 1: abs(below + own - wanted)}
            best = min(errors, key=errors.__getitem__)
            cuts[n] = (widest[n], best, None)
            if errors[best] > slack:
                torn[n] = (value, wanted - below)
        if torn:
            inside = current.where(F.col("key") == _choose({n: v for n, (v, _) in torn.items()}))
            for n, (value, below, own) in _crossing(inside, "_order", {n: (round(t), 1) for n, (_, t) in torn.items()}).items():
                wanted = torn[n][1]
                cuts[n] = (widest[n], torn[n][0], value + 1 if below + own - wanted < wanted - below else value)
        for n, (a, b) in wide.items():
            middle = _halves((a, b))[0]
            del nodes[n]
            nodes[2 * n], nodes[2 * n + 1] = (a, middle), (middle, b)
            if n not in shape:
                nodes[n] = (a, a + 1)
    shard = F.lit(None).cast("int")
    for n, (a, _) in nodes.items():
        shard = F.when(F.col("_node") == n, F.lit(a)).otherwise(shard)
    sharded = points.withColumn("_node", leaf()).withColumn("shard", shard)
    slots = running(sharded, ["shard"], ["_id", "_g", "_order"], {"_nth": ("row_number",)}, hot_rows=SLOT_ROWS)
    return slots.select(*before, "shard", (F.col("_nth") - 1).alias("slot"))
