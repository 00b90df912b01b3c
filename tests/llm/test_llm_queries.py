"""The registered queries at the smallest scale: against their SQL, or against brute force over the whole tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import queries
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs():
    frame = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    return [(d, t or "") for d, t in frame]


def words(text, pattern=WORD):
    return pattern.findall(text.encode().translate(FOLD))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked_components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {d: find(d) for d in sets}


def repeats(texts, least=400):
    seen = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    found = con.execute(queries.ORACLES[name])
    want = pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_quality_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, sf).toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.predicted == 1) == (got.score >= 0.3)).all()
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (held.predicted == held.quality).mean() > 0.9


def test_suffix_dedup(spark, docs):
    want = {d: x for (d, _), x in zip(docs, repeats([t.encode() for _, t in docs]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in queries.op2_suffix_dedup(spark, SF).collect()} == want


def test_language_model(spark, docs):
    tokens = {d: [*words(t), 0] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    better = []
    for r in queries.op3_language_model(spark, SF).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r.score <= 0
        better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9


def test_jaccard_join(spark, docs):
    sets = {d: shingles(t) for d, t in docs}
    roots = linked_components(sets)
    assert {r[0]: tuple(r)[1:] for r in queries.op4_jaccard_join(spark, SF).collect()} == {d: (len(sets[d]), roots[d]) for d in sets}


def test_sharding(spark, docs):
    got = queries.op6_sharding(spark, SF).toPandas()
    text = dict(docs)
    assert sorted(got.doc_id) == sorted(text) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.shard) == set(range(24))
    assert (got.groupby("shard")["size"].sum() - got["size"].sum() / 24).abs().max() <= got["size"].max()


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in docs}
    got = queries.op7_packing(spark, SF).toPandas()
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert list(pieces.start) == list(np.cumsum([0, *pieces.length])[:-1]) and pieces.length.sum() == len(ids[d]) == pieces.doc_tokens.iloc[0]
        for r in pieces.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    assert set(got.doc_id) == set(ids)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert list(sequence.offset) == list(np.cumsum([0, *sequence.length])[:-1]) and sequence.length.sum() <= 2048


def test_decontamination(spark, docs):
    windows = collections.defaultdict(set)
    for item, text in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall():
        w = words(text or "", ALNUM)
        for g in [tuple(w[i : i + 10]) for i in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows[g].add(item)
    sizes = {len(g) for g in windows}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_decontamination(spark, SF).collect()}
    for d, text in docs:
        w, hit, items = words(text, ALNUM), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[tuple(w[i : i + size])]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert got[d] == (len(w), len(hit), len(items), digest, bool(hit))


def test_token_files(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_token_files(spark, SF).collect()}
    at = 0
    for d, text in sorted(docs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline_stages(spark):
    """Each stage on what the one before kept: the right documents go, the others are unchanged."""
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    all_docs = queries.table(spark, SF, "documents")
    state = {r.doc_id: tuple(r) for r in all_docs.collect()}
    df = all_docs
    for name in names[:-1]:
        df = spark.createDataFrame(stages[name](spark, df, SF).collect(), all_docs.schema)
        now = {r.doc_id: tuple(r) for r in df.collect()}
        assert all(state[d] == r for d, r in now.items()) and df.columns == all_docs.columns
        text = {d: r[1] or "" for d, r in state.items()}
        if name == names[0]:
            scored = {r.doc_id: r.predicted for r in queries.op1_quality(spark, SF).collect()}
            assert set(now) == {d for d, p in scored.items() if p}
        elif name == names[1]:
            last = {}
            for d in sorted(text):
                last[text[d].encode().translate(FOLD)] = d
            assert set(now) == set(last.values())
        elif name == names[2]:
            roots = linked_components({d: shingles(t) for d, t in text.items()})
            assert set(now) == {d for d, r in roots.items() if d == r}
        else:
            hit = {r.doc_id: r.contaminated for r in queries.op9_decontamination(spark, SF).collect()}
            assert set(now) == {d for d in text if not hit[d]}
        state = now
    packed = stages[names[-1]](spark, df, SF).toPandas()
    assert set(packed.doc_id) == set(state)
