"""Lineage edges, reachability and table flow over the normalized tables.

Joins are on the artifact together with a name or step, so an artifact's rows spread over many partitions.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import qualified_name, uniq_refs
from tracewell.operators.keyed import dedupe_first, dedupe_last
from tracewell.session import work_path, written

# Edge kinds, classifications, derivation text.
STRUCTURAL = "structural"
INFERRED = "inferred-deterministic"
FLOW_DERIVATION = "reachable explicit step dependency path"
FIELD_DECLARATION = "structural-field-declaration"


def resolve_hops(hops: DataFrame, steps: DataFrame) -> DataFrame:
    """Enabled hops with step ids; the last step of a name counts, an unknown name stands for itself."""
    named = steps.where((F.col("name") != "") & (F.col("step_id") != ""))
    ids = dedupe_last(named.select("artifact_id", "name", "step_id", "position"), ["artifact_id", "name"], ["position"])
    source = ids.select("artifact_id", F.col("name").alias("from_name"), F.col("step_id").alias("_from"))
    target = ids.select("artifact_id", F.col("name").alias("to_name"), F.col("step_id").alias("_to"))
    return (
        hops.where("enabled")
        .join(source, ["artifact_id", "from_name"], "left")
        .join(target, ["artifact_id", "to_name"], "left")
        .select(
            "artifact_id",
            "position",
            "from_name",
            "to_name",
            F.coalesce("_from", "from_name").alias("from_id"),
            F.coalesce("_to", "to_name").alias("to_id"),
            "evidence_refs",
        )
    )


def step_dependencies(hops: DataFrame, steps: DataFrame) -> DataFrame:
    """Dependencies between steps, once per pair, with the evidence of the first hop."""
    return dedupe_first(resolve_hops(hops, steps), ["artifact_id", "from_id", "to_id"], ["position"]).withColumn(
        "classification", F.lit(STRUCTURAL)
    )


def attach_endpoints(endpoints: DataFrame, steps: DataFrame) -> DataFrame:
    """Endpoints with a step: their own, else the first step whose qualified name or bare table has their name."""
    schema = F.coalesce("schema_name", F.lit(""))
    table = F.coalesce("table_name", F.lit(""))
    names = F.array_distinct(F.array(qualified_name(schema, table), table))
    by_name = (
        steps.select("artifact_id", "position", "step_id", F.explode(names).alias("name"))
        .where(F.col("name") != "")
        .groupBy("artifact_id", "name")
        .agg(F.min_by("step_id", "position").alias("_by_name"))
    )
    return (
        endpoints.join(by_name, ["artifact_id", "name"], "left")
        .withColumn("step_id", F.coalesce("step_id", "_by_name"))
        .drop("_by_name")
        .select(*endpoints.columns)
    )


def _edge(df: DataFrame, kind: Column | str, src: Column, dst: Column, cls: Column, derivation: Column | None = None) -> DataFrame:
    return df.select(
        "artifact_id",
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        src.alias("src"),
        dst.alias("dst"),
        cls.alias("classification"),
        (derivation if derivation is not None else F.lit(None)).cast("string").alias("derivation"),
        "evidence_refs",
    )


def _node(kind: str, name: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(name))


def step_edges(resolved: DataFrame) -> DataFrame:
    """One edge per enabled hop, repeats included."""
    return _edge(resolved, "step_dependency", _node("step", "from_id"), _node("step", "to_id"), F.lit(STRUCTURAL))


def read_write_edges(attached: DataFrame) -> DataFrame:
    """Edges between tables and steps; an endpoint found in SQL text is inferred and says how."""
    known = attached.where(F.col("step_id").isNotNull())
    cls = F.coalesce("classification", F.lit(STRUCTURAL))
    reads = F.col("direction") == "source"
    table, step = _node("table", "name"), _node("step", "step_id")
    return _edge(
        known,
        F.when(reads, "reads_from").otherwise("writes_to"),
        F.when(reads, table).otherwise(step),
        F.when(reads, step).otherwise(table),
        F.when(cls == STRUCTURAL, STRUCTURAL).otherwise(INFERRED),
        F.when(cls != STRUCTURAL, cls),
    )


def workflow_edges(dependencies: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Edges from a pipeline to the ones it calls."""
    ids = pipelines.select("artifact_id", F.col("id").alias("_pipeline"))
    joined = dependencies.join(ids, "artifact_id")
    return _edge(joined, "workflow_dependency", _node("pipeline", "_pipeline"), _node("pipeline", "to_name"), F.lit(STRUCTURAL))


def column_declarations(fields: DataFrame) -> DataFrame:
    """Fields as declared columns, without any claim of column lineage."""
    return fields.withColumn("lineage_classification", F.lit(FIELD_DECLARATION))


def reachable_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Pairs (start, node) per artifact; a start reaches itself, and cycles end by themselves.

    ``edges`` has artifact_id, from_id, to_id; ``starts`` has artifact_id, step_id. Null steps reach nothing. Paths are
    doubled: round n knows all nodes within 2 ** n - 1 steps and the pairs of nodes exactly 2 ** n steps apart, and joins
    the one to the other, so the rounds grow with the logarithm of the longest path. A round that finds nothing new is
    the last, as it looked at least one step further. Rounds are written to the shared folder, so the plan stays small
    and a lost executor costs at most one round.
    """
    spark = starts.sparkSession
    folder = work_path(spark, "reachable")
    pair = ["artifact_id", "start", "node"]

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = edges.select("artifact_id", F.col("from_id").alias("node"), F.col("to_id").alias("next"))
    leap = stored(links.where("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct(), "leap=0")
    first = starts.select("artifact_id", F.col("step_id").alias("start"), F.col("step_id").alias("node"))
    found = stored(first.where(F.col("node").isNotNull()).distinct(), "found=0")
    for n in count(1):
        ahead = found.join(leap, ["artifact_id", "node"]).select("artifact_id", "start", F.col("next").alias("node"))
        new = stored(ahead.distinct().join(found, pair, "left_anti"), f"found={n}")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        onward = leap.select("artifact_id", F.col("node").alias("next"), F.col("next").alias("far"))
        leap = stored(leap.join(onward, ["artifact_id", "next"]).select("artifact_id", "node", F.col("far").alias("next")).distinct(), f"leap={n}")


def table_flow(attached: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges from source to target tables whose steps are connected, with both sides' evidence."""
    read = ["artifact_id", "step_id", "direction", "name", "position", "evidence_refs"]
    known = written(attached.where(F.col("step_id").isNotNull()).select(*read), "known")
    sources = known.where(F.col("direction") == "source").select(
        "artifact_id", F.col("step_id").alias("start"), F.col("name").alias("_source"),
        F.col("position").alias("_sp"), F.col("evidence_refs").alias("_sr"),
    )
    targets = known.where(F.col("direction") == "target").select(
        "artifact_id", F.col("step_id").alias("node"), F.col("name").alias("_target"),
        F.col("position").alias("_tp"), F.col("evidence_refs").alias("_tr"),
    )
    with_target = sources.join(targets.select("artifact_id").distinct(), "artifact_id", "left_semi")
    pairs = reachable_pairs(dependencies, with_target.select("artifact_id", F.col("start").alias("step_id")))
    joined = pairs.join(targets, ["artifact_id", "node"]).join(sources, ["artifact_id", "start"])
    merged = joined.withColumn("evidence_refs", uniq_refs(F.concat("_sr", "_tr")))
    return _edge(
        merged, "table_flow", _node("table", "_source"), _node("table", "_target"), F.lit(INFERRED), F.lit(FLOW_DERIVATION)
    )


def lineage_edges(tables: dict[str, DataFrame], flow: bool = True) -> DataFrame:
    """All structural and inferred edges of a corpus in one table."""
    resolved = resolve_hops(tables["hops"], tables["steps"])
    attached = attach_endpoints(tables["endpoints"], tables["steps"])
    parts = [
        step_edges(resolved),
        read_write_edges(attached),
        workflow_edges(tables["dependencies"], tables["pipelines"]),
    ]
    if flow:
        parts.append(table_flow(attached, step_dependencies(tables["hops"], tables["steps"])))
    return reduce(DataFrame.unionByName, parts)


def pair_evidence(claims: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Merged evidence for claimed source and target pairs of a pipeline.

    Claims hold artifact_id, source and target; a pair whose tables the pipeline does not have is left out.
    Evidence of a table named several times is merged in order of discovery.
    """

    def side(direction: str, name: str, refs: str) -> DataFrame:
        rows = endpoints.where(F.col("direction") == direction)
        listed = F.array_sort(F.collect_list(F.struct("position", "evidence_refs")))
        return rows.groupBy("artifact_id", F.col("name").alias(name)).agg(
            F.flatten(F.transform(listed, lambda r: r["evidence_refs"])).alias(refs)
        )

    return (
        claims.join(side("source", "source", "_s"), ["artifact_id", "source"])
        .join(side("target", "target", "_t"), ["artifact_id", "target"])
        .withColumn("evidence_refs", uniq_refs(F.concat("_s", "_t")))
        .drop("_s", "_t")
    )
