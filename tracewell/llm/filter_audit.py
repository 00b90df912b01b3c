"""How filters interact: Shapley values by removal-game potentials, and what each step of every filter order removes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.session import written

MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a whole text that isn't null; words are runs without ASCII white space."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    upper = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * upper > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, good, toxic`` and one boolean column A to E for every row of ``docs``.

    A: under 100 words. B: fewer than 80 distinct words in 100. C: over a tenth of the code points are A-Z. D: one of
    ``#$%&*|`` occurs. E: the text is that of a row with a smaller id. A null text is empty, and a null part is the empty
    string. A null id is smaller than none and larger than none, so that its rows neither fail E nor make others fail;
    of rows that share the smallest id of a text none fails. ``good`` and ``toxic`` tell whether any row of ``labels``
    for the id has quality 1 or toxic 1. Other columns are not read.

    Texts are read once and compared by SHA-256 digest. What moves is a narrow row per document: the smallest id of a
    digest is an aggregate, and it comes back by a join on digest and id, so copies of one text spread over all tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        *[c.alias(n) for n, c in text_failures(text).items()],
    )
    rows = written(narrow, "failures")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("is_first"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    marked = rows.join(first, ["digest", "id"], "left").join(known, "id", "left")
    return marked.select(
        "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "A", "B", "C", "D",
        (F.col("id").isNotNull() & F.col("is_first").isNull()).alias("E"),
    )


def _at(values: Column, coalition: Column) -> Column:
    """The element of an array for a coalition, which is a bit set."""
    return F.element_at(values, coalition.cast("int") + 1)


def potentials(removed: Column, filters: int) -> Column:
    """Potentials of the removal game, the one of each coalition S times |S|!, from what every coalition removes.

    The potential of no filter is zero; that of S is the mean over its members of the potential without the member, plus
    a share of what S removes: |S| P(S) = removed(S) + sum of P(S without i). Scaled by |S|! all are whole numbers:
    Q(S) = (|S| - 1)! removed(S) + sum of Q(S without i). Every subset has a smaller number than its superset, so one pass in
    ascending order finds them all.
    """
    share = F.array(*[F.lit(factorial(max(n - 1, 0))).cast("long") for n in range(filters + 1)])

    def extended(known: Column, coalition: Column) -> Column:
        value = _at(share, F.bit_count(coalition)) * _at(removed, coalition)
        for i in range(filters):
            without = coalition.bitwiseAND(~(1 << i))
            value = value + F.when(coalition.bitwiseAND(1 << i) != 0, _at(known, without)).otherwise(F.lit(0).cast("long"))
        return F.concat(known, F.array(value))

    coalitions = F.sequence(F.lit(1), F.lit((1 << filters) - 1))
    return F.aggregate(coalitions, F.array(F.lit(0).cast("long")), extended)


def coalition_sums(failures: DataFrame, filters: Sequence[str], part: str, measures: dict[str, Column]) -> DataFrame:
    """Per part, ``total`` rows and for each measure an array: what a coalition of filters removes of it, by its bit set.

    Rows are counted by part and set of failed filters first, which leaves at most 2 ** filters rows a part.
    """
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    summed = failures.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("coalition")
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = [F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(n) for n in measures]
    by_coalition = summed.select("*", coalition).groupBy("part", "coalition").agg(F.sum("rows").alias("total"), *sums)
    ordered = F.array_sort(F.collect_list(F.struct("coalition", *measures)))
    return by_coalition.groupBy("part").agg(F.first("total").alias("total"), ordered.alias("_all")).select(
        "part", "total", *[F.col(f"_all.{n}").alias(n) for n in measures]
    )


def filter_interactions(failures: DataFrame, filters: Sequence[str], part: str = "part", lost: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of all ``filters`` and step, for rows that a filter removes where its column is true.

    Returns ``part, filter_order`` (names joined), ``step`` (from 1), ``filter``, ``kept`` (rows left after the step),
    ``removed`` (by it), ``redundant`` (failing it, removed earlier), ``unique_fails`` (failing it only), a column for each
    condition in ``lost`` (such rows removed by the step) and ``shapley``: the filter's removed rows summed over all orders.
    A null condition counts as false. Parts come from the rows, so an empty table gives none; a part without any failure
    has all its rows, with zeros. At most MOST_FILTERS filters, as orders grow with their factorial.

    An order's steps are differences between coalitions: what the filters up to the step remove, less what those before
    it remove. The Shapley value is the potential of all filters less the potential without the filter.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    lost = lost or {}
    failed = failures.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in filters})
    measures = {"rows": F.lit(1).cast("long")} | {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in lost.items()}
    sums = coalition_sums(failed, filters, part, measures).withColumn("potential", potentials(F.col("rows"), k))
    orders = F.array(*[F.array(*[F.lit(i) for i in order]) for order in permutations(range(k))])
    walked = sums.withColumn("_order", F.explode(orders)).select("*", F.posexplode("_order").alias("_step", "_filter"))
    bits = F.transform("_order", lambda i: F.pow(F.lit(2), i).cast("int"))
    before = F.aggregate(F.slice(bits, F.lit(1), F.col("_step")), F.lit(0), lambda a, b: a + b)
    bit = F.pow(F.lit(2), F.col("_filter")).cast("int")
    steps = walked.withColumns({"_before": before, "_bit": bit}).withColumn("_after", F.col("_before") + F.col("_bit"))
    rows, full = F.col("rows"), (1 << k) - 1
    others = F.lit(full) - F.col("_bit")
    removed = _at(rows, F.col("_after")) - _at(rows, F.col("_before"))
    names = F.array(*[F.lit(f) for f in filters])
    grand, without = _at(F.col("potential"), F.lit(full)), _at(F.col("potential"), others)
    return steps.select(
        "part", F.array_join(F.transform("_order", lambda i: F.element_at(names, i + 1)), "").alias("filter_order"),
        (F.col("_step") + 1).alias("step"), F.element_at(names, F.col("_filter") + 1).alias("filter"),
        (F.col("total") - _at(rows, F.col("_after"))).alias("kept"), removed.alias("removed"),
        (_at(rows, F.col("_bit")) - removed).alias("redundant"), (_at(rows, F.lit(full)) - _at(rows, others)).alias("unique_fails"),
        *[(_at(F.col(n), F.col("_after")) - _at(F.col(n), F.col("_before"))).alias(n) for n in lost],
        (grand - k * without).alias("shapley"),
    )
