"""Toxicity: held-out accuracy, the label model on simulated votes, mining among copies, and odd input."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries, toxicity

EN = "the of and to in is that it was for on are as with his they at be this from".split()


def prose(rng, size, words=()):
    out = [f"{rng.choice(EN)}{rng.choice(EN)}" for _ in range(size)]
    for w in words:
        out[int(rng.integers(size))] = w
    return " ".join(out)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, sf).toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.predicted == 1) == (got.score >= 0.7)).all()
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    bad, fine = held[held.toxic == 1], held[held.toxic == 0]
    assert len(got) == 10_000 and (bad.score.to_numpy()[:, None] > fine.score.to_numpy()[None]).mean() > 0.95
    assert bad.predicted.mean() > 0.8 and fine.predicted.mean() < 0.01


def test_accuracies_and_correlations(spark):
    """Votes from known chances, labels of a tenth; one voter copies another, which must not count twice."""
    rng = np.random.default_rng(1)
    n, chance = 40_000, [(0.7, 0.02), (0.5, 0.05), (0.6, 0.1), (0.4, 0.01)]
    label = rng.random(n) < 0.2
    cast = np.stack([rng.random(n) < np.where(label, a, b) for a, b in chance], 1)
    copied = np.where(rng.random(n) < 0.95, cast[:, 2], rng.random(n) < 0.2)
    votes = (np.concatenate([cast, copied[:, None]], 1).astype(np.int64) << np.arange(5)).sum(1)
    known = np.where(rng.random(n) < 0.1, label, -1)
    unique, count = np.unique(np.stack([votes, known], 1), axis=0, return_counts=True)
    frame = spark.createDataFrame([(int(v), int(k), int(c)) for (v, k), c in zip(unique, count, strict=True)], "votes long, known int, n long").repartition(3)
    model = toxicity.label_model(frame, 5, 0.3)
    assert {(2, 4), (4, 2)} & {(i, int(p)) for i, p in enumerate(model.parent)}
    assert abs(model.prior - 0.2) < 0.04
    for i in (0, 1, 3):
        found = np.exp(model.table[:, i, toxicity.TOXIC, 0])
        if model.parent[i] < 0:
            assert np.allclose(found[::-1], chance[i], atol=0.06)
    sure = (model.posterior(votes) >= 0.5) == label
    truth = toxicity.LabelModel(0.2, np.full(4, -1), np.log(np.array([[[[1 - c[1 - y]] * 3, [c[1 - y]] * 3, [1e-9] * 3] for c in chance] for y in (0, 1)])))
    best = (truth.posterior((cast.astype(np.int64) << np.arange(4)).sum(1)) >= 0.5) == label
    assert sure.mean() > best.mean() - 0.01


def test_known_rows_anchor_the_labels(spark):
    rows = [(1, 1, 50), (2, 0, 200), (1, -1, 100), (2, -1, 400), (0, -1, 300)]
    model = toxicity.label_model(spark.createDataFrame(rows, "votes long, known int, n long"), 2, 0.2)
    assert model.posterior(np.array([1]))[0] > 0.9 > 0.1 > model.posterior(np.array([2]))[0]


def test_words_of_copies_are_not_mined(spark):
    """Toxic documents share stems; one of them has hundreds of near copies, whose other words must not become terms."""
    rng = np.random.default_rng(5)
    bad = ["grobnik", "zorvatch", "plimuxe"]
    rows = [(i, prose(rng, 80), 0) for i in range(300)]
    rows += [(1000 + i, prose(rng, 60, [f"{b}{rng.choice(['', 'en', 'er', 'ly'])}" for b in rng.choice(bad, 3)]), 1) for i in range(60)]
    base = prose(rng, 60, [f"{b}er" for b in bad]) + " onlyhere nowhereelse"
    rows += [(2000 + i, f"{base} {i}", 1) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string").repartition(3)
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, known int")
    voters = toxicity.learn_voters(docs, known)
    hits = [toxicity.Words(pa.array([w])).found(np.unique(voters.keys), voters.leads)[0].size > 0 for w in ("grobnikisch", "zorvatch", "plimuxe", "onlyhere", "nowhereelse", "theand")]
    assert hits == [True, True, True, False, False, False]
    model = toxicity.train(docs.withColumnRenamed("id", "doc_id"), known.toDF("doc_id", "toxic"), F.lit(True))
    texts = {1: f"{prose(rng, 30)} grobnikeln {prose(rng, 9)} zorvatcher", 2: prose(rng, 50), 3: f"onlyhere {prose(rng, 40)} nowhereelse"}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert (got[1].predicted, got[2].predicted, got[3].predicted) == (1, 0, 0)


def test_votes():
    known = toxicity.voters([toxicity.listed_terms("grob zorv")])
    names = known.names
    texts = [
        None, "", " ... 12", "a plain line of words", "GROB", "zorv! zorv", "you utter idiot", "IDIOT AND MORON ARE BAD WORDS", "wait!! what", "what the f*ck", "sooooo", "trashy grobber",
        "x " * 2_000_000 + "zorv",
    ]
    votes, numbers = toxicity.signals(pa.array(texts), known)
    toxic = [[n for i, n in enumerate(names) if v >> i & 1] for v in votes.tolist()]
    clean = [[n for i, n in enumerate(names) if v >> i + 32 & 1] for v in votes.tolist()]
    assert toxic == [
        [], [], [], [], ["mined 0"], ["mined 0", "several"], ["english", "german", "french", "addressed"], ["english", "german", "french", "shouting", "several"],
        ["exclaiming"], ["masked"], ["drawn out"], [], ["mined 0"],
    ]
    assert clean == [[], [], [], ["several", "plain"], [], [], [], [], ["several"], ["several"], ["several"], ["several", "plain"], []]
    assert (numbers[:2] == 0).all() and numbers.shape[1] == len(toxicity.NUMBERS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "you idiot"), (3, "you idiot"), (4, "é ü 中文 İ"), (5, "word " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for name in ("score", "id", "votes", "known", "learn", "sketches"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (5, 0), (4, None), (2, 7)], "doc_id long, toxic int").withColumn("known", F.lit(1))
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity_scores(odd, labels, F.lit(True)).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s, _ in got)
    by = {d: s for d, s, _ in got}
    assert by[1] == by[2] and by[3] == by[None] > by[5]
    model = toxicity.train(odd, labels, F.lit(True))
    again = toxicity.score(odd, model)
    assert {(r.doc_id, round(r.score, 9)) for r in again.collect()} == {(d, round(s, 9)) for d, s, _ in got}
    assert set(odd.columns) <= set(again.columns)


def test_nothing_to_learn_from(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, learn in ((none, F.lit(True)), (spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(None).cast("boolean"))):
        got = toxicity.toxicity_scores(odd, labels, learn).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(odd.limit(0), none, F.lit(True)).count() == 0
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), none, F.lit(True))).count() == 0
