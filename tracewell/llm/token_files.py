"""Token files: canonical length-limited Huffman codes from global counts, in blocks that decode independently."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewell.llm import tokens
from tracewell.session import work_path, written

MAX_BITS = 16
BLOCK = 512
SEGMENT = 1 << 20
PART_TOKENS = 1 << 23
HEADER = struct.Struct("<4sIQI")
MAGIC = b"THF1"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels, packages = len(order), [], np.empty(0, np.int64)
    for _ in range(most):
        merged = np.concatenate([weight, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place)
        merged = merged[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, own = 2 * n - 2, np.zeros(n, np.int64)
    for place in reversed(levels):
        chosen = place[:take]
        own[chosen[chosen < n]] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of every id: shorter codes first, equal lengths in order of id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of MAX_BITS bits the id that its first bits code, and how many bits that took."""
    ids, taken = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    start = codes[used].astype(np.int64) << (MAX_BITS - lengths[used].astype(np.int64))
    order = np.argsort(start)
    width = 1 << (MAX_BITS - lengths[used].astype(np.int64))
    filled = int(width.sum())
    ids[:filled], taken[:filled] = np.repeat(used[order], width[order]), np.repeat(lengths[used][order], width[order])
    return ids, taken


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of the ids and the bit offset at which every block of BLOCK ids starts."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    word = start >> 5
    shift = 64 - (start & 31) - size
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    n = (total >> 5) + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(float), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes(), start[::BLOCK]


def unpack_bits(payload: np.ndarray, offsets: np.ndarray, n: int, ids: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The n ids: every block is read from its own offset, and all blocks advance together, one id a step."""
    out = np.zeros((len(offsets), BLOCK), np.uint32)
    at = offsets.astype(np.int64)
    last = n - (len(offsets) - 1) * BLOCK
    for step in range(min(BLOCK, n)):
        if step == last and len(offsets):
            at = at[:-1]
        byte = at >> 3
        seen = (payload[byte].astype(np.int32) << 16) | (payload[byte + 1].astype(np.int32) << 8) | payload[byte + 2]
        window = (seen >> (8 - (at & 7))) & 0xFFFF
        out[: len(at), step] = ids[window]
        at = at + taken[window]
    return out.reshape(-1)[:n]


def encode_segment(doc_ids: list, ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One segment: header, document ids and token counts, block offsets in bits, then the bit stream."""
    whole = np.concatenate(ids)
    payload, offsets = pack_bits(whole, lengths, codes)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    counts = np.array([len(i) for i in ids], "<u8")
    return b"".join(
        [HEADER.pack(MAGIC, len(doc_ids), len(whole), BLOCK), null.tobytes(), known.tobytes(), counts.tobytes(), offsets.astype("<u8").tobytes(), payload]
    )


def decode_segment(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids of the segment."""
    magic, docs, n, block = HEADER.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token segment")
    at, out = HEADER.size, []
    for kind, size in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u8", -(-n // BLOCK))):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    null, known, counts, offsets = out
    ids = unpack_bits(np.frombuffer(data, np.uint8, offset=at), offsets, n, *table)
    return [None if x else d for x, d in zip(null.tolist(), known.tolist(), strict=True)], counts.astype(np.int64), ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, fold: bool, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``n`` and the ids of each text (``end_id`` last) as little-endian integers of ``id_type``."""
    kind = id_type(tokenizer, fold)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, offsets in tokens.encoded(batches, tokenizer, fold, end_id):
            ids = ids.astype(kind)
            blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ids.itemsize * offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(offsets)), blob.cast(pa.binary())], ["doc", "n", "ids"])

    return rows.mapInArrow(run, "doc long, n long, ids binary")


def id_type(tokenizer: str, fold: bool) -> str:
    """Two bytes an id where the vocabulary allows it; ids wait and move in this form before they are coded."""
    return "<u2" if tokens.encoder(tokenizer, fold).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; the result is as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = np.bincount(np.frombuffer(blob, kind))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, fold: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the ids of every text to ``path``, documents in ascending order of id, coded by their global counts.

    ``path/codes`` has the code length of each id, which is all that canonical codes need. ``path/segments`` has
    rows ``part, segment, tokens, data``: parts in order of their number, segments in order inside a part; ``data``
    is one binary segment of whole documents, about SEGMENT ids. Null texts are empty (one end id), null ids come
    first, and rows that repeat an id follow each other. Texts are tokenized once; their ids wait in the shared
    folder. Documents are range partitioned by id and text, so that no id, however frequent, fills one task.
    """
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer, end_id, fold, id_col, text_col), "ids", compression="zstd")
    kind = id_type(tokenizer, fold)
    counts = id_counts(ids, kind)
    width = np.dtype(kind).itemsize
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            data = encode_segment(names, held, lengths, codes)
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "tokens": size, "data": data}])

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and size + len(blob) // width > SEGMENT:
                    yield row()
                    segment, names, held, size = segment + 1, [], [], 0
                names.append(doc)
                held.append(np.frombuffer(blob, kind))
                size += len(blob) // width
        if held:
            yield row()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_TOKENS + 1)
    tied = ids.select("doc", "ids", F.xxhash64("ids").alias("tie"))
    ordered = tied.repartitionByRange(parts, "doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "ids")
    ordered.mapInArrow(run, "part long, segment long, tokens long, data binary").write.parquet(f"{path}/segments")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc, start, n_tokens, ids_crc32`` and the ``ids`` of every document in the files; ``start`` counts the ids before it."""
    code_rows = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in code_rows), default=0) + 1, np.uint8)
    for r in code_rows:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, canonical(lengths))
        for batch in batches:
            for part, segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, counts, ids = decode_segment(data, table)
                ends = np.cumsum(counts)
                each = np.split(ids, ends[:-1])
                columns = [
                    [part] * len(names), [segment] * len(names), names, ends - counts, counts,
                    [zlib.crc32(i.astype("<u4").tobytes()) for i in each], [i if with_ids else None for i in each],
                ]
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "segment", "doc", "inside", "n_tokens", "ids_crc32", "ids"])

    segments = spark.read.schema("part long, segment long, tokens long, data binary").parquet(f"{path}/segments")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_part = segments.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("seg_start"))
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    docs = segments.select("part", "segment", "data").mapInArrow(run, "part long, segment long, doc long, inside long, n_tokens long, ids_crc32 long, ids array<int>")
    starts = in_part.join(parts, "part").select("part", "segment", (F.col("seg_start") + F.col("part_start")).alias("before"))
    return docs.join(starts, ["part", "segment"]).select("doc", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, fold: bool = False, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Writes token files to the shared folder and returns what they hold when read back."""
    path = work_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, fold, id_col, text_col)
    return read_tokens(docs.sparkSession, path, with_ids).withColumnRenamed("doc", id_col)
