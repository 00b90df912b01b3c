"""Vector codes of one index per part, with exact nearest entries found by slices of sorted coordinates and bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import flat
from tracewell.scale import spread_join
from tracewell.session import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_ROWS = 32_768
BROADCAST_ROWS = 500_000


class EntrySlices:
    """Exact nearest entries of one part: every dimension's coordinates in order, each with the mask of the entries before it.

    Entry i is bit i % 64 of mask word i // 64. The entries whose coordinate lies in a range are the difference of two
    masks, and those in a box are the AND over dimensions.
    """

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        self.entries, words = entries, (count + 63) // 64
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0).T.copy()
        self.before = np.zeros((width, count + 1, words), np.uint64)
        for d in range(width):
            for i, e in enumerate(order[:, d].tolist()):
                self.before[d, i + 1] = self.before[d, i]
                self.before[d, i + 1, e // 64] |= np.uint64(1) << np.uint64(e % 64)
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0])) if width and count else 0
        self.by_widest = order[:, self.widest] if width else np.zeros(count, np.int64)

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, the lowest index of those at one distance.

        The entry next to a row in the widest dimension gives the first radius. No entry outside the box of that radius is
        nearer, so the exact distances of the entries inside decide.
        """
        count, width = self.entries.shape
        if not width:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        at = np.searchsorted(self.sorted[self.widest], x[:, self.widest])
        best = self._distance(x, self.by_widest[np.minimum(at, count - 1)])
        best = np.minimum(best, self._distance(x, self.by_widest[np.maximum(at - 1, 0)]))
        radius = np.floor(np.sqrt(best)).astype(np.int64) + 1
        inside = np.full((len(x), self.before.shape[2]), ~np.uint64(0))
        for d in range(width):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            inside &= self.before[d, high] ^ self.before[d, low]
        found, best = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        for word in range(inside.shape[1]):
            left = inside[:, word]
            rows = np.flatnonzero(left)
            left = left[rows]
            while len(rows):
                lowest = left & (~left + np.uint64(1))
                entry = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) + 64 * word
                distance = self._distance(x[rows], entry)
                nearer = distance < best[rows]
                best[rows[nearer]], found[rows[nearer]] = distance[nearer], entry[nearer]
                left = left ^ lowest
                rows, left = rows[left != 0], left[left != 0]
        return found, best


@dataclass
class Codebooks:
    """Integer entries by part: an array of parts x entries x components."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _vectors(batches: Iterator[pa.RecordBatch], width: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            flat_values = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part, flat_values.reshape(part.num_rows, width)


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, x.shape[1] // parts)


def integer_vectors(vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows whose vector is whole, with ``ints`` (floor of each component times ``scale``) in place of it, and its length.

    Rows are dropped whose vector is null or holds a null or non-finite component. The length of a vector is the one that
    most of the others have (of equally frequent ones the largest); a vector of another length lacks components and is
    dropped as well. ValueError if that length isn't a multiple of ``parts``. A component so large that distances leave
    64 bits (32,768 and more at 64 components) is refused with an error, as the codes' errors could not be told.
    """
    whole = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = whole.groupBy(F.size(vector_col).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    top = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    width = top["n"] if top else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    most = int((2.0**62 / max(width, 1)) ** 0.5 / 2)

    def checked(x):
        n = x.cast("double") * scale
        return F.when(F.abs(n) < most, F.floor(n).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {most} or more")).cast("int"))

    kept = whole.where(F.size(vector_col) == width)
    return kept.withColumn("ints", F.transform(vector_col, checked)), width


def train_codebooks(ints: DataFrame, width: int, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of the rows with the smallest ids (then by components; null ids last).

    In each of ``rounds`` passes, every part of every row goes to its nearest entry, and an entry becomes the floor of
    the mean of its parts; an unused one stays. Tasks send sums and counts by entry, and the driver holds the codebooks only:
    ``entries`` times ``width`` numbers.
    """
    first = ints.orderBy(F.asc_nulls_last(id_col), "ints").limit(entries).select("ints").toArrow().column("ints")
    seeds = np.array([v.as_py() for v in first], np.int64).reshape(len(first), width)
    books = Codebooks(_split(seeds, parts).transpose(1, 0, 2).copy())
    if not len(seeds):
        return books
    cells = books.entries.size

    for _ in range(rounds):
        shared = ints.sparkSession.sparkContext.broadcast(books.entries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            n_parts, n_entries, size = now.shape
            slices = [EntrySlices(e) for e in now]
            sums, counts = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for _, x in _vectors(batches, width, "ints"):
                for p, own in enumerate(_split(x, n_parts).transpose(1, 0, 2)):
                    code, _ = slices[p].nearest(own)
                    counts[p] += np.bincount(code, minlength=n_entries)
                    for d in range(size):
                        sums[p, :, d] += np.bincount(code, own[:, d], n_entries).astype(np.int64)
            at = np.flatnonzero(counts.reshape(-1)) if counts.any() else np.zeros(0, np.int64)
            cell = flat.ranges(at * size, np.full(len(at), size)) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cell, cells + at])), pa.array(np.concatenate([sums.reshape(-1)[cell], counts.reshape(-1)[at]]))], ["cell", "value"]
            )

        got = ints.select("ints").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(cells + books.entries.shape[0] * books.entries.shape[1], np.int64)
        total[np.array(got.column("cell"), np.int64)] = np.array(got.column("value"), np.int64)
        counts = total[cells:].reshape(books.entries.shape[:2])
        means = total[:cells].reshape(books.entries.shape) // np.maximum(counts, 1)[:, :, None]
        books = Codebooks(np.where(counts[:, :, None] > 0, means, books.entries))
        shared.unpersist()
    return books


def assign_codes(ints: DataFrame, width: int, books: Codebooks) -> DataFrame:
    """All columns but ``ints``, with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts)."""
    rest = [c for c in ints.columns if c not in ("ints", "code", "error")]
    rows = ints.select(*[F.col(f"`{c}`") for c in rest], "ints")
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [EntrySlices(e) for e in shared.value]
        for part, x in _vectors(batches, width, "ints"):
            codes, error = [], np.zeros(len(x), np.int64)
            for p, own in enumerate(_split(x, len(slices)).transpose(1, 0, 2)):
                code, distance = slices[p].nearest(own)
                codes.append(code)
                error += distance
            text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(slices)
            named = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], named, pa.array(error)], [*rest, "code", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, code string, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` for every row with a whole vector.

    Components become whole numbers, vectors are cut into ``parts`` equal consecutive parts, and each part is coded by the
    index of its nearest codebook entry (see ``train_codebooks``; at most 256 entries, ties to the lower index).
    ``label_error`` is the error summed over the rows of the same label, rows without a label together. Repeated ids
    and repeated rows are rows like others; with fewer rows than entries a codebook has as many entries as rows. An empty
    table gives no rows. Other columns are not read. For dropped rows and refused components see ``integer_vectors``.

    The whole-number table is written once and read by each round. Label sums come back by a broadcast of a counted size,
    or by a join that spreads a label of very many rows.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"1 to 256 entries, not {entries}")
    plain = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    ints, width = integer_vectors(plain, "vector", parts)
    stored = written(ints.drop("vector"), "vectors")
    books = train_codebooks(stored, width, "id", parts, entries, rounds)
    if not books.entries.size and width:
        named = stored.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        named = written(assign_codes(stored, width, books), "codes")
    keyed = named.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = written(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")), "label_errors")
    few = sums.count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(sums), ["_none", "_label"]) if few else spread_join(keyed, sums, ["_none", "_label"], "inner")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
