"""Words of over a thousand bytes that polynomial hashes cannot tell apart, and pieces that share a forced hash."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import flat, jaccard_join, language_model, packing, token_files, tokens

SWAP = str.maketrans("ab", "ba")


def thue_morse(size):
    word = "a"
    while len(word) < size:
        word += word.translate(SWAP)
    return word[:size]


ALIKE = [w for n in (256, 257, 1024, 2048, 65_536) for w in (thue_morse(n), thue_morse(n).translate(SWAP))]


def test_spans_are_told_apart():
    data = np.frombuffer("".join(ALIKE * 2).encode(), np.uint8)
    size = np.array([len(w) for w in ALIKE] * 2)
    start = np.cumsum(size) - size
    hashes = flat.span_hash(data, start, start + size)
    assert len(set(hashes.tolist())) == len(ALIKE) and (hashes[: len(ALIKE)] == hashes[len(ALIKE) :]).all()
    pairs, n = np.arange(0, len(ALIKE), 2), len(ALIKE)
    assert not flat.same_spans(data, start[pairs], data, start[pairs + 1], size[pairs]).any()
    assert flat.same_spans(data, start[:n], data, start[n:], size[:n]).all()


@pytest.mark.parametrize("size", range(0, 40))
def test_short_spans(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, len(data) - size + 1, 300)
    raw = [data[s : s + size].tobytes() for s in start]
    hashes = flat.span_hash(data, start, start + size)
    assert len(set(hashes.tolist())) == len(set(raw)) == len(set(zip(raw, hashes.tolist(), strict=True)))
    other = rng.permutation(start)
    assert flat.same_spans(data, start, data, other, np.full(300, size)).tolist() == [data[a : a + size].tobytes() == data[b : b + size].tobytes() for a, b in zip(start, other, strict=True)]


@pytest.mark.parametrize(("name", "fold"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_of_alike_words(spark, name, fold, monkeypatch):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [*ALIKE, *[f"x {w} y" for w in ALIKE], "Plain words, and more."]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    read = token_files.token_files(frame, public_tokenizers.path(name), end_id=2, fold=fold, with_ids=False)
    crc = {i: zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for i, w in enumerate(want)}
    assert {r.doc_id: r.ids_crc32 for r in read.collect()} == crc
    if not fold:
        found = {i: [] for i in range(len(texts))}
        for r in packing.pack(frame, public_tokenizers.path(name), end_id=2).orderBy("doc_id", "start").collect():
            found[r.doc_id] += r.ids
        assert [found[i] for i in range(len(texts))] == [[*w, 2] for w in want]
    # Hashes of two bits only: nearly all pieces share one, and the bytes have to decide.
    real = flat.span_hash
    monkeypatch.setattr(flat, "span_hash", lambda *a: real(*a) & np.uint64(6))
    encoder = tokens.PieceEncoder(public_tokenizers.path(name), fold)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array([*texts[-8:], "one two three two one <|endoftext|> four"]))
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [*want[-8:], plain.encode("one two three two one <|endoftext|> four", add_special_tokens=False).ids]


def test_sets_and_counts_of_alike_words(spark):
    a, b = thue_morse(1024), thue_morse(1024).translate(SWAP)
    rows = [(1, f"{a} one two three four five six"), (2, f"{b} one two three four five six"), (3, f"{a} one two three four five six"), (4, a), (5, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.similarity_components(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    scored = {r.doc_id: r for r in language_model.score_texts(frame, F.col("doc_id") == 5).collect()}
    assert scored[5].n_known == 2 and scored[4].n_known == 2 and language_model.score_texts(frame.where("doc_id <> 2"), F.col("doc_id") == 5).where("doc_id = 5").first().n_known == 1
