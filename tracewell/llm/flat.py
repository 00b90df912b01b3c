"""Many texts as one byte array: views over Arrow columns, word positions and hashes, without row loops."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T

BATCH_BYTES, PIECE_BYTES, SMALL_BYTES, LONG_SPAN = 4 << 20, 4 << 20, 1 << 20, 256
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MIX)
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << max(n - 1, 1).bit_length()
        with np.errstate(over="ignore"):
            up = np.full(n, BASE, np.uint64)
            down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and len+1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python by the bytes they have, as 10,000 rows of long texts would fill the memory of JVM and worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives memory that is free back to the system; a worker process outlives its tasks and would keep their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` text bytes (or one row), which bounds a task's arrays; after the last
    one, free memory is given back."""
    for batch in batches:
        yield from slices(batch, column, most)
    release()


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of one batch in slices of at most ``most`` text bytes (or one row)."""
    if not batch.num_rows:
        return
    _, offsets = texts(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def appended(df: DataFrame, text_col: str, fields: list[T.StructField], compute, most: int = PIECE_BYTES) -> DataFrame:
    """All rows and columns of ``df`` with new last columns: ``compute(slice's text column)`` gives their arrays.

    A column that has the name of a new one is replaced.
    """
    df = df.drop(*[f.name for f in fields if f.name in df.columns and f.name != text_col])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, most):
            new = compute(part.column(place))
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i bytes; window_hash turns differences into hashes of windows."""
    up, _ = _powers_to(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[flat] * up[: len(flat)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end, for windows that overlap; equal bytes have equal hashes wherever they stand.

    Unlike windows of over a thousand bytes can be built that share it, so it may group bytes but never decide.
    """
    _, down = _powers_to(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * MIX)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed in, a step that no multiplication alone undoes; spans of over LONG_SPAN bytes, of
    which a text has few, get xxh3.
    """
    at, size = eight_bytes(data), (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * MIX + MIX)
    short = size <= LONG_SPAN
    left = np.arange(len(size)) if short.all() else np.flatnonzero(short)
    done = 0
    while len(left):
        rest = size[left] - done
        out[left] = mix(out[left] ^ (at[start[left] + done] & LOW_BYTES[np.minimum(rest, 8)])) + MIX
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def same_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``start`` on equal those of the other array from ``other_start`` on."""
    a, b = eight_bytes(data), eight_bytes(other)
    out = np.ones(len(size), bool)
    left, done = np.flatnonzero(size > 0), 0
    while len(left):
        if done == LONG_SPAN:
            for i in left.tolist():
                out[i] = np.array_equal(data[start[i] + done : start[i] + size[i]], other[other_start[i] + done : other_start[i] + size[i]])
            break
        rest = size[left] - done
        gap = (a[start[left] + done] ^ b[other_start[left] + done]) & LOW_BYTES[np.minimum(rest, 8)]
        out[left] &= gap == 0
        left, done = left[(rest > 8) & (gap == 0)], done + 8
    return out


def words(flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of word bytes, and each text's first word; runs never cross texts."""
    inside = np.zeros(len(flat) + 1, bool)
    inside[:-1] = is_word[flat]
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    opens[cuts] = inside[cuts]
    start = np.flatnonzero(opens)
    closes = inside[:-1] & ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For len+1 bounds, the index of the group that each element from bounds[0] to bounds[-1] is in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... of count[0] numbers, then those of the next group, in one array."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


#: Bytes that words consist of: all but white space, and ASCII letters and digits with every non-ASCII byte.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
