"""Filter interactions against a walk over every order, row by row."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(90_000))
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "A B C " * 60, "en"), (4, "A B C " * 60, "en"), (None, "A B C " * 60, "en"),
    (5, "A B C " * 60, "de"), (6, LONG, "de"), (7, LONG + " $", ""), (8, "é ü x " * 50, "fr"), (9, "clean " + " ".join(f"v{i}" for i in range(120)), "en"),
    (10, "A" * 10 + "a" * 90, "en"), (11, "A" * 11 + "a" * 89, "en"), (12, "x|y", "de"), (None, None, None),
]
LABELS = [(1, 1, 0), (4, 0, 1), (4, 1, None), (6, 1, 0), (None, 1, 1), (12, None, 1), (99, 1, 1)]


def walked(rows):
    """Counts by part, order and step from rows of (part, failed filters, conditions)."""
    out, orders = collections.defaultdict(lambda: [0] * 6), list(itertools.permutations("ABCDE"))
    shapley = collections.Counter()
    for part, fails, good, toxic in rows:
        for order in orders:
            first = min((order.index(f) for f in fails), default=5)
            for i, f in enumerate(order):
                cell = out[part, "".join(order), i + 1]
                cell[0] += first > i
                cell[1] += first == i
                cell[2] += f in fails and first < i
                cell[3] += fails == {f}
                cell[4] += good and first == i
                cell[5] += toxic and first == i
                shapley[part, f] += first == i
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(frame):
    rows = frame.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    assert all(r.filter == r.filter_order[r.step - 1] for r in rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def audit(failures):
    return filter_audit.filter_interactions(failures, "ABCDE", lost={"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def test_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    for clash in ("A", "E", "part", "mask", "digest", "id", "good", "_step"):
        docs = docs.withColumn(clash, F.lit("clash"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    good, toxic = ({r[0] for r in LABELS if r[0] is not None and r[i] == 1} for i in (1, 2))
    want = []
    for doc, text, lang in ROWS:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tests = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in ROWS),
        }
        want.append((lang or "", {f for f, hit in tests.items() if hit}, doc in good, doc in toxic))
    assert result(audit(filter_audit.document_failures(docs, labels))) == walked(want)
    none = filter_audit.document_failures(docs.limit(0), labels)
    assert audit(none).count() == 0
    assert result(audit(filter_audit.document_failures(docs, labels.limit(0)))).keys() == walked(want).keys()


def test_random_failures(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{rng.integers(3)}", *(bool(x) for x in rng.random(7) < 0.3)) for _ in range(400)] + [("clean", *[False] * 7)]
    frame = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    want = walked([(r[0], {f for f, hit in zip("ABCDE", r[1:6], strict=True) if hit}, r[6], r[7]) for r in rows])
    assert result(audit(frame)) == want
    assert want["clean", "ABCDE", 5] == (1, 0, 0, 0, 0, 0, 0)


def test_names_nulls_and_other_numbers_of_filters(spark):
    rows = [("x", True, None), ("x", None, None), ("x", True, True), (None, False, True)]
    got = filter_audit.filter_interactions(spark.createDataFrame(rows, "part string, short boolean, dirty boolean"), ["short", "dirty"]).collect()
    by = {(r.part, r.filter_order, r.filter): (r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got}
    assert by["x", "shortdirty", "short"] == (1, 1, 2, 0, 1, 3) and by["x", "shortdirty", "dirty"] == (2, 1, 0, 1, 0, 1)
    assert by[None, "dirtyshort", "dirty"] == (1, 0, 1, 0, 1, 2)
    with pytest.raises(ValueError, match="filters"):
        filter_audit.filter_interactions(spark.range(1), [])
