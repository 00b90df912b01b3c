"""Exact duplicates by content-defined chunk recipes: chunks get verified identifiers, documents are lists of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm import flat
from tracewell.llm.keep import keep_rows
from tracewell.session import written

MEAN_BITS, LEAST, MOST, WINDOW = 11, 256, 16384, 32
GEAR = (flat.BYTE_VALUES & np.uint64(0xFFFFFFFF)).astype(np.uint32)

OCCURRENCE = pa.struct([("row", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("sha", pa.binary())])
CHUNKS = pa.schema([("h", pa.int64()), ("chunk", pa.binary()), ("seen", pa.list_(OCCURRENCE))])
CHUNKS_DDL = "h long, chunk binary, seen array<struct<row long, doc long, mark long, pos int, sha binary>>"


def cut_points(text: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of one or more texts laid end to end, before length rules.

    A gear hash over 32 bytes, built by doubling its window; a chunk ends where its upper bits are zero.
    """
    h = GEAR[text]
    width = 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint32(width)
        h[width:] = h[width:] + shifted
        width *= 2
    return np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1


def text_cuts(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of one text: candidates at least LEAST bytes apart, forced ones MOST bytes after the last."""
    own = candidates[np.searchsorted(candidates, start + LEAST) : np.searchsorted(candidates, end)]
    out, at, i = [], start, 0
    while end - at > LEAST:
        i += int(np.searchsorted(own[i:], at + LEAST))
        cut = int(own[i]) if i < len(own) else end
        at = min(cut, at + MOST)
        if at >= end:
            break
        out.append(at)
    out.append(end)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct chunks of a slice of documents with all their places; the digest of a text goes with its first."""
    for part in flat.pieces(batches, "text"):
        data, offsets = flat.texts(part.column("text"))
        data = flat.LOWER[data]
        candidates, raw = cut_points(data), data.tobytes()
        folded: dict[bytes, list] = {}
        rows = zip(part.column("row").to_pylist(), part.column("doc").to_pylist(), part.column("mark").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        for row, doc, mark, start, end in rows:
            sha = hashlib.sha256(memoryview(raw)[start:end]).digest()
            at = start
            for pos, cut in enumerate(text_cuts(candidates, start, end)):
                folded.setdefault(raw[at:cut], []).append((row, doc, mark, pos, sha))
                at, sha = cut, None
        keys = list(folded)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)).view(np.int64)
        places = [p for k in keys for p in folded[k]]
        seen = pa.StructArray.from_arrays(
            [pa.array([p[i] for p in places], f.type) for i, f in enumerate(OCCURRENCE)], fields=list(OCCURRENCE)
        )
        ends = np.cumsum([0, *(len(folded[k]) for k in keys)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, seen, type=CHUNKS.field("seen").type)], schema=CHUNKS
        )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: unique ``row``, its id ``doc``, ``mark`` (hash of the text as it is), digest ``sha`` of the normalised text, and its ``recipe``.

    A chunk's identifier is its hash and its rank among different chunks of that hash. The ranks come from comparing
    the bytes, so equal recipes mean equal texts. A chunk's bytes move once per slice of input at most, and to the
    partition of their hash only; documents move as lists of identifiers.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"),
    )
    same_hash = Window.partitionBy("h").orderBy("chunk")
    places = (
        numbered.mapInArrow(_chunks, CHUNKS_DDL)
        .select("h", F.dense_rank().over(same_hash).alias("v"), "seen")
        .select("h", "v", F.inline("seen"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "h", "v")))
    return places.groupBy("row").agg(
        F.max("doc").alias("doc"),
        F.max("mark").alias("mark"),
        F.max("sha").alias("sha"),
        F.transform(in_order, lambda c: F.struct(c["h"].alias("h"), c["v"].alias("v"))).alias("recipe"),
    )


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, mark, sha, keep, group_size, kept`` of every row; only groups of two and more are joined back."""
    lists = written(recipes(docs, id_col, text_col), "recipes")
    groups = lists.groupBy("recipe").agg(F.max(F.struct("doc", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    copies = written(groups.where("group_size > 1"), "copies")
    own = F.struct("doc", "row")
    return lists.join(copies, "recipe", "left").select(
        "doc", "mark", "sha", F.coalesce("keep.doc", F.when(F.col("keep").isNull(), F.col("doc"))).alias("keep"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(own["row"] == F.col("keep.row"), F.lit(True)).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its group of equal texts: ``keep_id`` stays (the largest id), the others are dropped.

    Returns ``id_col, keep_id, group_size, kept, text_sha256`` for every row. Texts are equal when identical after
    lower-casing A-Z; null counts as empty, and empty texts are one group. A null id counts as the smallest; where
    the largest id stands in several rows of a group, one of them stays. Other columns of ``docs`` are not read.
    A document's list of identifiers is held by one task; a group of copies is only ever aggregated and joined.
    """
    return grouped(docs, id_col, text_col).select(
        F.col("doc").alias(id_col), F.col("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(docs, grouped(docs, id_col, text_col), id_col, text_col)
