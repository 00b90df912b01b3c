"""Deleted interpolation: bigram and unigram estimates mixed by how often the context was seen, weights from EM."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm import flat
from tracewell.session import work_path, written

BUCKET_TOKENS = 2_000_000
END = flat.mix(np.array([0xE2D], np.uint64))[0]
CONTEXTS, BINS, ROUNDS = 42, 96, 200
UNIGRAM, BIGRAM = 0, 1

SLICE = "batch long, docs array<long>, held array<boolean>, lengths array<long>, tokens long, train_tokens long, vocabulary binary, places binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def sliced(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per slice of documents: their ids and lengths in tokens, the slice's distinct words by ascending hash,
    and each token's place among them. Every text is read as words and one end.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        for part in flat.pieces(batches, "text"):
            data, offsets = flat.texts(part.column("text"))
            data = flat.LOWER[data]
            start, end, first = flat.words(data, offsets, flat.NOT_SPACE)
            words = np.insert(flat.span_hash(data, start, end), first[1:], END)
            vocabulary, places = np.unique(words, return_inverse=True)
            lengths = np.diff(first) + 1
            held = np.array(part.column("held").to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch]), pa.array([part.column("doc").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()]), pa.array([lengths.tolist()]),
                 pa.array([len(words)]), pa.array([int(lengths[~held].sum())]), pa.array([vocabulary.tobytes()]), pa.array([_packed(places.astype(np.int32))])],
                ["batch", "docs", "held", "lengths", "tokens", "train_tokens", "vocabulary", "places"],
            )
            batch += 1

    return rows.mapInArrow(run, SLICE)


class Slice:
    """The tokens of a stored slice, its bigrams by ascending key, and which tokens are for training."""

    def __init__(self, row: dict):
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.word = _unpacked(row["places"], "<i4").astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        self.context[starts] = np.searchsorted(self.vocabulary, END)
        pairs, place = np.unique(self.context * len(self.vocabulary) + self.word, return_inverse=True)
        a, b = np.divmod(pairs, len(self.vocabulary))
        with np.errstate(over="ignore"):
            keys = flat.mix(flat.mix(self.vocabulary[a]) * flat.MIX + self.vocabulary[b])
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.keys, self.pair = keys[order], rank[place]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _keyed(slices: DataFrame, buckets: int) -> DataFrame:
    """Per slice, kind and bucket: the distinct keys in order and their counts in the slice's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, out = Slice(row), []
                for kind, keys, place in ((UNIGRAM, own.vocabulary, own.word), (BIGRAM, own.keys, own.pair)):
                    counts = np.bincount(place[own.train], minlength=len(keys))
                    bounds = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(bounds)).tolist():
                        part, n = keys[bounds[b] : bounds[b + 1]], counts[bounds[b] : bounds[b + 1]]
                        # 40 bits tell a bucket's bigrams apart; words keep all 64.
                        blob = part.tobytes() if kind == UNIGRAM else _short(part)
                        out.append((b, kind, row["batch"], blob, _packed(n.astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["bucket", "kind", "batch", "keys", "counts"])

    return slices.mapInArrow(run, "bucket long, kind long, batch long, keys binary, counts binary")


def _short(keys: np.ndarray) -> bytes:
    scaled = keys & np.uint64((1 << 40) - 1)
    return (scaled & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (scaled >> np.uint64(32)).astype(np.uint8).tobytes()


def _long(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _summed(keyed: DataFrame) -> DataFrame:
    """The same rows with the counts of all training documents; ``known`` words were seen in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (bucket, kind), group in groupby(rows, key=lambda r: (r["bucket"], r["kind"])):
            members = list(group)
            keys = [np.frombuffer(r["keys"], np.uint64) if kind == UNIGRAM else _long(r["keys"]) for r in members]
            sizes = [len(k) for k in keys]
            unique, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate([_unpacked(r["counts"], "<u4") for r in members]), len(unique)).astype(np.int64)
            known = int((total > 0).sum())
            for r, own in zip(members, np.split(total[place], np.cumsum(sizes)[:-1]), strict=True):
                yield pa.RecordBatch.from_pylist([{"batch": r["batch"], "kind": kind, "bucket": bucket, "counts": _packed(own.astype("<u8" if own.max() >> 32 else "<u4")), "wide": bool(own.max() >> 32), "known": known}])
                known = 0

    ordered = keyed.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind")
    return ordered.mapInArrow(run, "batch long, kind long, bucket long, counts binary, wide boolean, known long")


def _counts(rows: list[dict], kind: int) -> np.ndarray:
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([_unpacked(r["counts"], "<u8" if r["wide"] else "<u4").astype(np.int64) for r in own])


class Tokens:
    """Per token of a slice: the counts of its word, its context and the pair."""

    def __init__(self, row: dict):
        self.slice = Slice(row)
        unigram, bigram = _counts(row["found"], UNIGRAM), _counts(row["found"], BIGRAM)
        self.word, self.context, self.pair = unigram[self.slice.word], unigram[self.slice.context], bigram[self.slice.pair]
        self.pair = np.minimum(self.pair, np.minimum(self.context, self.word))

    def estimates(self, total: int, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context class and the two maximum-likelihood estimates; ``deleted`` takes each training token out first."""
        out = (self.slice.train if deleted else np.zeros(len(self.word), bool)).astype(np.int64)
        context = self.context - out
        pair = np.where(context > 0, (self.pair - out) / np.maximum(context, 1), 0.0)
        single = (self.word - out) / max(total - 1 if deleted else total, 1)
        return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), np.maximum(pair, 0), np.maximum(single, 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for impossible, else half octaves of the probability."""
    return np.where(p > 0, 1 + np.minimum((-2 * np.log2(np.where(p > 0, p, 1))).astype(np.int64), BINS - 2), 0)


def _expectation_maximisation(cells: list, uniform: float) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate per context class, from counts of their binned values."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    table = np.array([(r["context"], r["n"], r["pair"] / r["n"], r["single"] / r["n"]) for r in cells]).reshape(-1, 4)
    for c in range(CONTEXTS):
        own = table[table[:, 0] == c]
        p = np.stack([own[:, 2], own[:, 3], np.full(len(own), uniform)], 1)
        w = np.array([0.0, 0.9, 0.1]) if c == 0 else weights[c]
        for _ in range(ROUNDS if len(own) else 0):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * own[:, 1:2]).sum(0) / own[:, 1].sum()
            w = np.maximum(w, [0.0 if c == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[c] = w
    return weights


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are lower-case A-Z words between ASCII white space, and one end per text; null texts are an end only.
    Counts come from the rows where ``held_out`` is not true. ``base_score`` is the add-one unigram score. ``score``
    is the log10 probability under weights[c] . (c(context, word) / c(context), c(word) / N, 1 / (V + 1)), where the
    class c is the octave of the context's count and a text's first word has the end as context. The weights are
    learned by expectation-maximisation on all training tokens with each token's own occurrence deleted from the
    counts. With no training rows all counts are 0 and both scores are the uniform ones. Repeated rows count as often as
    they stand there; other columns are not read.

    A slice of documents sends each of its distinct words and word pairs once, and gets back their counts in the same
    order, so no frequent word gathers more rows than there are slices. Slices are stored in buckets of their
    number, so that counts meet them without moving them. Pairs are told apart by a 40-bit hash inside a bucket of
    about BUCKET_TOKENS tokens (with words by 64 bits); about one pair in half a million shares a count.
    """
    spark = docs.sparkSession
    name, path = f"lm_{uuid.uuid4().hex}", work_path(spark, "slices")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = sliced(docs, held_out, id_col, text_col).write.format("parquet").option("path", path)
    writer.bucketBy(parts, "batch").saveAsTable(name)
    slices = spark.table(name)
    sums = slices.agg(F.sum("tokens"), F.sum("train_tokens")).first()
    total = int(sums[1] or 0)
    buckets = int(sums[0] or 0) // BUCKET_TOKENS + 1
    counts = written(_summed(_keyed(slices, buckets)), "counts")
    vocabulary = int(counts.where(F.col("kind") == UNIGRAM).agg(F.sum("known")).first()[0] or 0)
    uniform = 1.0 / (vocabulary + 1)
    found = counts.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "counts", "wide")).alias("found"))
    joined = slices.join(found, "batch").select("docs", "held", "lengths", "vocabulary", "places", "found")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Tokens(batch.slice(i, 1).to_pylist()[0])
                kept = own.slice.train
                context, pair, single = (x[kept] for x in own.estimates(total, True))
                code = (context * BINS + _bin(pair)) * BINS + _bin(single)
                cells, place = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(cells // BINS**2), pa.array(np.bincount(place, minlength=len(cells))),
                     pa.array(np.bincount(place, pair, len(cells))), pa.array(np.bincount(place, single, len(cells)))],
                    ["code", "context", "n", "pair", "single"],
                )

    binned = joined.mapInArrow(gather, "code long, context long, n long, pair double, single double")
    cells = binned.groupBy("code", "context").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"), F.sum("single").alias("single"))
    weights = _expectation_maximisation(cells.orderBy("code").collect(), uniform)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Tokens(row)
                n = len(own.slice.lengths)
                context, pair, single = own.estimates(total, False)
                w = weights[context]
                model = np.log10(w[:, 0] * pair + w[:, 1] * single + w[:, 2] * uniform)
                base = np.log10((own.word + 1) / (total + vocabulary + 1))
                per_doc = lambda v, n=n, own=own: np.bincount(own.slice.doc, v, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(row["held"]), pa.array(own.slice.lengths), pa.array(per_doc(own.word > 0).astype(np.int64)),
                     pa.array(np.full(n, total)), pa.array(per_doc(base)), pa.array(per_doc(model))],
                    ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    scored = joined.mapInArrow(judge, "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    result = written(scored, "scores")
    spark.sql(f"DROP TABLE {name}")
    return result.withColumnRenamed("doc", id_col)
