"""Quality classifier learned from trusted positives and unlabelled text by non-negative PU risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracewell.llm import flat

SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 1024, 0.01, 1e-4, 7

#: Byte classes: 0 A-Z, 1 a-z, 2 digit, 3 space, 4 other white space, 5 stop, 6 exclamation, 7 markup, 8 non-ASCII, 9 other.
CLASSES = np.full(256, 9, np.uint8)
CLASSES[65:91] = 0
CLASSES[97:123] = 1
CLASSES[48:58] = 2
CLASSES[32] = 3
CLASSES[9:14] = 4
CLASSES[np.frombuffer(b".,;:?", np.uint8)] = 5
CLASSES[np.frombuffer(b"!", np.uint8)] = 6
CLASSES[np.frombuffer(b"|<>{}[]()=_/\\", np.uint8)] = 7
CLASSES[128:] = 8


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text: byte classes, word lengths, repetition and line shape, all as shares or logs.

    They see nothing but the text; an empty or null text has its own defined row of zeros.
    """
    data, offsets = flat.texts(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    whole = np.maximum(size, 1)
    doc = flat.owners(offsets)
    classes = np.bincount(doc * 10 + CLASSES[data], minlength=10 * n).reshape(n, 10) / whole[:, None]
    start, end, first = flat.words(data, offsets, flat.NOT_SPACE)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    of = flat.owners(first)
    length = (end - start).astype(float)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, n) / some

    hashes = flat.span_hash(flat.LOWER[data], start, end)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(of[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(of[order], fresh, n) / some
    group = np.cumsum(fresh) - 1
    counts = np.bincount(group, minlength=1).astype(float)
    most = np.zeros(n)
    if len(order):
        np.maximum.at(most, of[order][fresh], counts)
    same = np.zeros(len(of))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    lead, tail = CLASSES[data[start]], CLASSES[data[end - 1]]
    all_upper = (lead == 0) & (length > 1) & (CLASSES[data[np.minimum(start + 1, len(data) - 1)]] == 0) if len(start) else np.zeros(0)
    long, short = length > 12, length <= 3
    lines = np.bincount(doc, data == 10, n) + 1
    mean = per_text(length)
    columns = [
        *classes.T, np.log1p(size) / 10, mean / 10, np.sqrt(np.maximum(per_text(length**2) - mean**2, 0)) / 10, distinct, most / some,
        per_text(same), per_text(lead == 0), per_text(all_upper), per_text(tail == 6), per_text(tail == 7), per_text(tail == 9),
        per_text(tail == 5), per_text((length == 1) & (tail >= 5) & (tail != 8)), per_text(long), per_text(short), np.log1p(lines) / 5,
        np.log1p(words / lines) / 5, per_text(lead == 9), per_text(lead == 2),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Model:
    """One hidden layer over standardised features; ``prior`` is the estimated share of positives."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(float)), -30, 30)))


def _gradients(z: np.ndarray, weights: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
    """Of a sum over rows whose derivative by the logit is ``slope``."""
    a, b, c, _ = weights
    h = np.tanh(z @ a + b)
    back = np.outer(slope, c) * (1 - h**2)
    return [z.T @ back, back.sum(0), h.T @ slope, slope.sum()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Minimises the risk ``prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))`` with the logistic loss.

    Where the second part falls below zero on a batch, its gradient is followed uphill, which stops the model from
    fitting the unlabelled rows as negatives. Without ``prior``, the plain classifier of P against U is fitted.
    """
    both = np.concatenate([positive, unlabelled]).astype(float)
    centre, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - centre) / scale, -8, 8) for x in (positive.astype(float), unlabelled.astype(float)))
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = max(1, max(len(p), len(u)) // BATCH)
    for epoch in range(EPOCHS):
        ps, us = np.array_split(rng.permutation(len(p)), rounds), np.array_split(rng.permutation(len(u)), rounds)
        rate = RATE * (1 - epoch / EPOCHS)
        for i, j in zip(ps, us, strict=True):
            if not len(i) or not len(j):
                continue
            zp, zu = p[i], u[j]
            fp, fu = (np.tanh(z @ weights[0] + weights[1]) @ weights[2] + weights[3] for z in (zp, zu))
            plus, minus, rest = (_sigmoid(fp) - 1) / len(i), _sigmoid(fp) / len(i), _sigmoid(fu) / len(j)
            if prior is None:
                up, uu = plus, rest
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                up, uu = (prior * (plus - minus), rest) if negative >= 0 else (prior * minus, -rest)
            grads = [x + y + DECAY * w for x, y, w in zip(_gradients(zp, weights, up), _gradients(zu, weights, uu), weights, strict=True)]
            step += 1
            for k, g in enumerate(grads):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, weights, prior if prior is not None else 1.0)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows: the smallest ratio of upper tails under a P-against-U score.

    Half of the rows fit the score, the others are ranked by it. Above any threshold the unlabelled tail holds at
    least ``prior`` times the positive tail; where no negative scores as high the two agree. A margin for chance,
    which shrinks with the tails, keeps small tails from deciding.
    """
    half = fit(positive[::2], unlabelled[::2], None)
    p, u = np.sort(half.score(positive[1::2])), np.sort(half.score(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    at = np.quantile(p, np.linspace(0, 0.95, 96))
    tail_p, tail_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(((tail_u + margin) / np.maximum(tail_p, 1e-9)).argmin())
    return float(np.clip(tail_u[best] / max(tail_p[best], 1e-9), 0.05, 0.98))


def train(docs: DataFrame, positives: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``sample`` trusted positives and as many unlabelled documents, chosen by hash of the id.

    ``positives`` has the ids of trusted documents. Only rows of ``docs`` with ``learn`` are used. The broadcast holds
    at most twice ``sample`` ids, and as many rows of features reach the driver. None without positives or documents.
    """

    def chosen(ids: DataFrame, kind: int) -> DataFrame:
        known = ids.where(F.col(id_col).isNotNull()).where(learn).select(id_col).distinct()
        return known.orderBy(F.xxhash64(id_col, F.lit(kind)), id_col).limit(sample).withColumn("_kind", F.lit(kind))

    ids = chosen(docs.select(id_col).join(positives.select(id_col).distinct(), id_col, "left_semi"), 1).unionByName(chosen(docs.select(id_col), 0))
    picked = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select("_kind", id_col, text_col)
    field = T.StructField("_x", T.ArrayType(T.FloatType()))
    width = features(pa.array([""])).shape[1]

    def compute(column: pa.Array) -> list[pa.Array]:
        x = features(column)
        return [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(x.reshape(-1)))]

    got = flat.appended(picked, text_col, [field], compute, flat.SMALL_BYTES).select("_kind", id_col, "_x").toArrow().sort_by([(id_col, "ascending")])
    x = np.array(got.column("_x").combine_chunks().flatten()).reshape(-1, width)
    kind = np.array(got.column("_kind"))
    positive, unlabelled = x[kind == 1], x[kind == 0]
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have one score of their own. Without a model (nothing to learn from) every score is 0.5.
    Columns named ``score`` or ``predicted`` are replaced.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        values = model.score(features(column)) if model else np.full(len(column), 0.5)
        return [pa.array(values), pa.array((values >= threshold).astype(np.int32))]

    return flat.appended(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, flat.SMALL_BYTES)
