"""URL rules as a sort-merge range join: prefixes become intervals, and one ordered sweep finds the innermost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.scale import running
from tracewell.session import written

SWEEP_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/ ? #``, ASCII lower case; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, "host/path") pairs."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(host: Column, path: Column) -> Column:
    """Labels from the top domain down, then the path: all URLs of a rule are neighbours in this order."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), path), "UTF-8")


def _boundaries(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals in order, each with the rule that is on top of the stack after it.

    Prefixes nest or are disjoint, so after a boundary at depth d the open rule is the last one opened at depth d.
    """
    clean = rules.where(F.col("rule").contains("/") & F.col("verdict").isNotNull()).select(
        "verdict",
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("host"),
        F.col("rule").substr(F.instr("rule", "/"), F.length("rule")).alias("path"),
    )
    unique = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    spans = unique.select("*", _key(F.col("host"), F.col("path")).alias("at"))
    opened = running(spans, [], ["at"], {"nth": ("row_number",)}, hot_rows=SWEEP_ROWS)
    closed = opened.select("host", "path", "verdict", F.concat("at", F.unhex(F.lit("FF"))).alias("at"), F.lit(None).cast("long").alias("nth"))
    edges = opened.unionByName(closed)
    swept = running(edges, [], ["at"], {"edge": ("row_number",), "opened": ("max", "nth")}, hot_rows=SWEEP_ROWS)
    levels = swept.withColumn("depth", 2 * F.col("opened") - F.col("edge"))
    started = F.when(F.col("nth").isNotNull(), F.col("edge"))
    top = running(levels.withColumn("start_edge", started), ["depth"], ["edge"], {"top": ("max", "start_edge")}, hot_rows=SWEEP_ROWS)
    names = swept.where("nth is not null").select(
        F.col("edge").alias("top"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length")
    )
    open_top = F.when(F.col("depth") > 0, F.col("top")).alias("top")
    return top.select("at", "edge", open_top).join(names, "top", "left").drop("top")


def match_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sweep_rows: int = SWEEP_ROWS
) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, the longest fitting ``rule`` and the ``verdict``.

    ``rules`` has ``rule`` ("host/path") and ``verdict``. A rule fits its host and all subdomains if the path
    starts with the rule's path; of several the longest text wins, then the longer host. Without a rule, and for
    null or malformed URLs (host and path empty), the verdict is ``default`` and the rule null. Repeated rules
    count once, with the greatest verdict text ("block" over "allow"); rules that are null or without a slash are
    ignored. Repeated pages are kept. A column of ``pages`` named like a new one is replaced.

    Each distinct URL stands once for every domain above it, so that a subdomain finds the rules of its parents.
    These keys and the rule boundaries are sorted together, and a running maximum carries the number of the last
    boundary forward; the boundary knows which nested rule is on top there. The sort is range partitioned, so no
    host, however frequent, meets in one task.
    """
    parsed = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    bounds = written(_boundaries(rules), "rule_edges")
    labels = F.split("host", r"\.")
    size = F.size(labels)
    urls = parsed.where("host <> ''").select("host", "path").distinct()
    keys = urls.select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.array_join(F.slice(labels, -n, n), "."))).alias("domain")
    ).select("host", "path", _key(F.col("domain"), F.col("path")).alias("at"))
    line = bounds.select("at", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "edge").unionByName(
        keys.select("at", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("long").alias("edge"))
    )
    swept = running(line, [], ["at", "kind", "host", "path"], {"last_edge": ("max", "edge")}, hot_rows=sweep_rows)
    tops = bounds.where("rule is not null").select(F.col("edge").alias("last_edge"), "rule", "verdict", "host_length")
    found = (
        swept.where("kind = 1")
        .join(tops, "last_edge")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    kept = parsed.drop(*[c for c in ("rule", "verdict") if c in pages.columns])
    return kept.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
