"""Vector bin packing of token pieces: the dot-product heuristic under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import tokens

POOL = 1024
PIECES_CACHED = 500_000

PIECES = pa.schema(
    [("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, pieces of documents, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    shortest_cut: int = 16


class Packer:
    """Packs a stream of pieces into sequences, holding at most POOL pieces and the one open sequence.

    A document is first cut into whole sequences; its rest joins the pool. A sequence is filled by taking, again and
    again, the piece with the largest dot product of its sizes and the room left, both as shares of the limits. When
    nothing fits whole, the longest piece is cut to fill the room exactly, unless only a few tokens are left.
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.sizes = np.zeros((POOL, 3))
        self.items: list = [None] * POOL
        self.free = list(range(POOL))[::-1]

    def add(self, row, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple]:
        """Takes a document with a flag per token that bears loss; gives the pieces of sequences that are complete."""
        at, n = 0, len(ids)
        bearing = np.concatenate([[0], np.cumsum(loss)])
        while n - at:
            end = min(n, at + self.limits.tokens, int(np.searchsorted(bearing, bearing[at] + self.limits.loss_tokens, "right")) - 1)
            end = max(end, at + 1)
            piece = (row, at, ids[at:end], n, bearing[at : end + 1] - bearing[at])
            if end < n or end - at == self.limits.tokens:
                yield from self._close([piece])
            else:
                if not self.free:
                    yield from self._fill()
                self._store(piece)
            at = end

    def finish(self) -> Iterator[tuple]:
        while len(self.free) < POOL:
            yield from self._fill()

    def _store(self, piece: tuple) -> None:
        slot = self.free.pop()
        self.items[slot] = piece
        self.sizes[slot] = len(piece[2]), 1, piece[4][-1]

    def _take(self, slot: int) -> tuple:
        piece, self.items[slot] = self.items[slot], None
        self.sizes[slot] = 0
        self.free.append(slot)
        return piece

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids, whole, bearing in pieces:
            yield row, start, ids, whole, int(bearing[-1]), self.next, offset
            offset += len(ids)
        self.next += 1

    def _fill(self) -> Iterator[tuple]:
        room, taken = self.most.copy(), []
        while room[0] > 0 and room[1] > 0:
            fits = (self.sizes[:, 0] > 0) & (self.sizes <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.sizes / self.most) @ (room / self.most), -1.0)
                slot = int(score.argmax())
                room -= self.sizes[slot]
                taken.append(self._take(slot))
                continue
            slot = int(self.sizes[:, 0].argmax())
            if not self.sizes[slot, 0] or room[0] < self.limits.shortest_cut and taken:
                break
            row, start, ids, whole, bearing = self._take(slot)
            cut = min(int(room[0]), int(np.searchsorted(bearing, room[2], "right")) - 1, len(ids))
            if cut < 1:
                self._store((row, start, ids, whole, bearing))
                break
            taken.append((row, start, ids[:cut], whole, bearing[: cut + 1]))
            if cut < len(ids):
                self._store((row, start + cut, ids[cut:], whole, bearing[cut:] - bearing[cut]))
            room -= (cut, 1, bearing[cut])
        yield from self._close(taken)


def _batch(pieces: list[tuple], with_ids: bool) -> pa.RecordBatch:
    rows, starts, ids, whole, loss, sequence, offset = zip(*pieces, strict=True)
    crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
    kept = [i.astype(np.int32) for i in ids] if with_ids else [None] * len(ids)
    columns = [rows, starts, list(map(len, ids)), crc, whole, loss, sequence, offset, kept]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), fold: bool = False,
    id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents with the sequence and the offset they are packed at.

    Every id of every document (``end_id`` after the text, null texts are empty, so no document is without ids) lies
    in one piece. Loss is borne by all ids but a document's first, which nothing predicts, or by those from the
    token number in column ``loss_from`` on (null: 0), as in instruction data where the prompt bears none.
    Repeated rows and ids are packed like any others; other columns are not read.

    Each partition is packed by itself in one pass without a shuffle, so memory is bounded by the pool and a lost task
    is repeated alike. Sequence ids are unique but have gaps between partitions. One sequence per partition may be
    short; all others lack fewer than ``shortest_cut`` tokens, unless the segments or loss tokens are used up.
    """
    loss = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(1)
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"), loss.cast("long").alias("loss_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        for part, ids, offsets in tokens.encoded(batches, tokenizer, fold, end_id, most=PIECES_CACHED):
            bounds = zip(part.column("row").to_pylist(), part.column("loss_from").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            for row, first, a, b in bounds:
                out.extend(packer.add(row, ids[a:b].copy(), np.arange(b - a) >= first))
                if len(out) >= 8192:
                    yield _batch(out, with_ids)
                    out = []
        out.extend(packer.finish())
        if out:
            yield _batch(out, with_ids)

    ddl = "row long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids array<int>"
    return rows.mapInArrow(run, ddl).withColumnRenamed("row", id_col)
