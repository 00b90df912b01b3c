"""Takes the rows that a deduplication keeps out of a table of documents, without moving the texts where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.session import written

BROADCAST_ROWS = 500_000


def _match(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join by id and text hash, nulls equal; ``rows`` is broadcast if a count shows that it is small."""
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")
    return docs.join(rows, docs["_doc"].eqNullSafe(rows["doc"]) & docs["_mark"].eqNullSafe(rows["mark"]), how)


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with their own columns.

    ``verdicts`` has one row per document: ``doc`` (its id), ``mark`` (xxhash64 of its text) and ``kept``. Rows that
    agree in both have equal ids and texts; where one of them is kept, exactly one stays.
    """
    marked = docs.withColumns({"_doc": F.col(id_col).cast("long"), "_mark": F.xxhash64(text_col)})
    by_row = verdicts.groupBy("doc", "mark").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    special = written(by_row.where("NOT any OR n > 1"), "special")
    plain = _match(marked, special.select("doc", "mark"), "left_anti")
    repeated = special.where("any").select("doc", "mark")
    if not repeated.isEmpty():
        once = _match(marked, repeated, "left_semi").dropDuplicates(["_doc", "_mark"])
        plain = plain.unionByName(once)
    return plain.select(*[F.col(f"`{c}`") for c in docs.columns])
