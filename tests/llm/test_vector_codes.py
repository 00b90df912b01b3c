"""Vector codes against plain comparison with every entry."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label error, digest) of rows of (id, vector, label), in Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts

    def cut(v, p):
        return v[p * width : (p + 1) * width]

    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                groups[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, i), own in groups.items():
            books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    by_label = collections.Counter()
    for _, _, error, label in out:
        by_label[label] += error
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for clash in ("id", "ints", "code", "error", "cell", "_label", "vector"):
        frame = frame.withColumn(clash, F.lit("clash"))
    return sorted((tuple(r) for r in vector_codes.vector_codes(frame, **options).collect()), key=str)


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) + 5, (rng.integers(-3, 3, 16) / 4096).tolist(), int(rng.integers(4)) if i % 5 else None) for i in range(120)]
    rows += [(1, None, 1), (2, [math.nan] + [0.5] * 15, 1), (3, [None] + [0.5] * 15, 2), (4, [math.inf] + [0.5] * 15, None), (4, [0.25] * 16, None)]
    rows += [(5, rows[0][1], 3), (None, [-0.00001] * 16, 3), (None, [7.0] * 16, None), (9, rows[4][1], 2), (6, [-30000.0] * 16, 9)]
    rows = as_float32(rows)
    assert run(spark, rows) == brute(rows)
    few = rows[:6]
    assert run(spark, few) == brute(few)
    assert run(spark, rows, parts=2, entries=100, rounds=2) == brute(rows, 2, 100, 2)


def test_lengths_and_large_components(spark):
    rows = as_float32([(i, [i / 10] * 8, 0) for i in range(5)])
    assert run(spark, [*rows, (7, [], 0), (8, [1.0] * 16, 0)]) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    assert [r[1:4] for r in run(spark, [(1, [], None)])] == [("00" * 8, 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [1.0] * 12, 0)])
    with pytest.raises(Exception, match="or more"):
        run(spark, [(1, [1e30] * 8, 0)])


@pytest.mark.parametrize("count", [1, 16, 63, 64, 65, 200])
def test_slices_give_the_nearest_entry(count):
    rng = np.random.default_rng(count)
    entries, x = rng.integers(-40, 40, (count, 4)), rng.integers(-60, 60, (500, 4))
    entries[count // 2] = entries[0]
    code, distance = vector_codes.EntrySlices(entries).nearest(x)
    all_distances = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (distance == all_distances.min(1)).all() and (code == all_distances.argmin(1)).all()


def test_label_of_most_rows_is_spread(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = as_float32([(i, rng.normal(0, 0.1, 8).tolist(), None if i % 3 else i) for i in range(90)])
    want = brute(rows)
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 3)
    assert run(spark, rows) == want
    spread = vector_codes.spread_join
    monkeypatch.setattr(vector_codes, "spread_join", lambda *args: spread(*args, hot_rows=20))
    assert run(spark, rows) == want
