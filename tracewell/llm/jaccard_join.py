"""Jaccard join of word shingles with signature trees: OR-combined bitmaps and size ranges prune pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm import flat
from tracewell.llm.components import components
from tracewell.llm.keep import keep_rows
from tracewell.session import written

WORDS = 5
HOT_LIST, HOT_DOCS, HOT_LOCAL = 65_536, 64, 4
CELL_ROWS, LEAF, FANOUT = 4096, 16, 8
SEEDS = flat.mix(np.arange(1, 4, dtype=np.uint64) * flat.MIX)
BROADCAST_IDS = 500_000
MANY_ROOTS, WIDE_BITS, MOST_WIDE, SPANNING_ROUNDS = 256, 8, 2048, 2
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text, ascending inside a text, and len+1 bounds.

    Texts are taken a few at a time, as each byte of them needs many bytes of arrays and each shingle only eight.
    """
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    parts = [_sets_of(part.column(0)) for part in flat.slices(batch, "text", flat.SMALL_BYTES)]
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
    return np.concatenate([values for values, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.texts(column)
    data = flat.LOWER[data]
    start, end, first = flat.words(data, offsets, flat.NOT_SPACE)
    word = flat.span_hash(data, start, end)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(word) - WORDS + 1, 0), np.uint64)
        for i in range(WORDS):
            rolled = rolled * STEP + word[i : len(word) - WORDS + 1 + i] if len(rolled) else rolled
        sizes = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(bounds[-1], np.uint64)
        long = count >= WORDS
        out[flat.ranges(bounds[:-1][long], sizes[long])] = rolled[flat.ranges(first[:-1][long], sizes[long])]
        for d in np.flatnonzero((count > 0) & ~long).tolist():
            value = np.uint64(count[d])
            for w in word[first[d] : first[d + 1]]:
                value = value * STEP + w
            out[bounds[d]] = value
    out = flat.mix(out)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    inner = bounds[:-1][bounds[:-1] < len(out)]
    fresh[inner] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def hot_shingles(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """At most HOT_LIST shingles that stand in many documents, from counts over all of them; any list gives right
    results, since it only says which shingles come last in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, text_col):
            values, counts = np.unique(shingle_sets(part.column(0))[0], return_counts=True)
            many = counts >= HOT_LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], ["h", "n"])

    counted = docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_DOCS)
    rows = counted.orderBy(F.desc("n"), "h").limit(HOT_LIST).select("h").toArrow()
    return np.sort(np.array(rows.column("h"), np.int64).view(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words; halves fold onto each other by OR. It has at least one bit a member, and up to
    WIDE_BITS as long as it has MOST_WIDE at most: the wider it is, the fewer unlike sets look alike."""
    each = 1 << (len(hashes) - 1).bit_length()
    width = max(64, each, min(WIDE_BITS * each, MOST_WIDE))
    bits = np.zeros(width, bool)
    bits[hashes & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def enough(overlap, a, b):
    """Whether an overlap makes sets of sizes a and b similar: 100 * overlap >= 80 * union."""
    return 9 * overlap >= 4 * (a + b)


class Node:
    """A node of a signature tree: its members' OR bitmap and size range, the most tokens that share bits, and the most
    that stand at or after the cell's shingle in the common order."""

    def __init__(self, sizes: np.ndarray, rooms: np.ndarray, bitmaps: list[np.ndarray], members: np.ndarray, children: list[Node]):
        self.members, self.children = members, children
        self.low, self.high, self.room = int(sizes[members].min()), int(sizes[members].max()), int(rooms[members].max())
        words = min(len(bitmaps[m]) for m in members)
        self.table = np.stack([fold(bitmaps[m], words) for m in members])
        self.spare = int((sizes[members] - np.bitwise_count(self.table).sum(1)).max())
        self.bitmap = np.bitwise_or.reduce(self.table)
        if children:
            self.table = None

    def may_match(self, other: Node) -> bool:
        """Whether sizes and the largest possible overlap leave room for a similar pair.

        Where the cell's shingle is the first that two sets share, they share no more than what stands after it.
        """
        if not enough(min(self.room, other.room), self.low, other.low):
            return False
        if 5 * self.high < 4 * other.low or 5 * other.high < 4 * self.low:
            return False
        words = min(len(self.bitmap), len(other.bitmap))
        shared = int(np.bitwise_count(fold(self.bitmap, words) & fold(other.bitmap, words)).sum())
        most = min(shared + min(self.spare_at(words), other.spare_at(words)), self.high, other.high)
        return bool(enough(most, self.low, other.low))

    def spare_at(self, words: int) -> int:
        """Bits that folding to fewer words merges count as shared by all of them."""
        lost = int(np.bitwise_count(self.bitmap).sum()) - int(np.bitwise_count(fold(self.bitmap, words)).sum())
        return self.spare + (lost if words < len(self.bitmap) else 0)


def signature_trees(sizes: np.ndarray, rooms: np.ndarray, bitmaps: list[np.ndarray]) -> list[Node]:
    """Roots of trees, one per bitmap width, so that no bitmap loses bits to a much smaller neighbour: leaves of up to
    LEAF members of neighbouring sizes, then FANOUT nodes under each node."""
    order = np.lexsort((np.arange(len(sizes)), sizes))
    widths = np.array([len(bitmaps[m]) for m in order])
    roots = []
    for own in np.split(order, np.flatnonzero(np.diff(widths)) + 1):
        level = [Node(sizes, rooms, bitmaps, own[i : i + LEAF], []) for i in range(0, len(own), LEAF)]
        while len(level) > 1:
            groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
            level = [Node(sizes, rooms, bitmaps, np.concatenate([c.members for c in g]), g) for g in groups]
        roots += level
    return roots


def dual_traversal(roots: list[Node], sizes: np.ndarray, rooms: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Pairs of members that may be similar, and whether they probably are, by the bits one has and the other lacks."""
    stack = [(a, b) for i, a in enumerate(roots) for b in roots[: i + 1]]
    while stack:
        a, b = stack.pop()
        if not a.may_match(b):
            continue
        if a.children or b.children:
            left, right = a.children or [a], b.children or [b]
            if a is b:
                stack.extend((x, y) for i, x in enumerate(left) for y in left[: i + 1])
            else:
                stack.extend((x, y) for x in left for y in right)
            continue
        words = min(a.table.shape[1], b.table.shape[1])
        x, y = fold(a.table, words)[:, None], fold(b.table, words)[None]
        nx, ny = sizes[a.members][:, None], sizes[b.members][None]
        x_only, y_only = np.bitwise_count(x & ~y).sum(2, dtype=np.int64), np.bitwise_count(y & ~x).sum(2, dtype=np.int64)
        room = np.minimum(rooms[a.members][:, None], rooms[b.members][None])
        possible = enough(np.minimum(np.minimum(nx - x_only, ny - y_only), room), nx, ny)
        if a is b:
            possible = np.tril(possible, -1)
        free = 1 - np.bitwise_count(y).sum(2) / (64 * words)
        likely = enough(nx - x_only / np.maximum(free, 0.05), nx, ny)
        for i, j in zip(*np.nonzero(possible), strict=True):
            yield int(a.members[i]), int(b.members[j]), bool(likely[i, j])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _cell_pairs(rows: list[dict], spanning: bool) -> Iterator[tuple[int, int]]:
    """Pairs of sets in one cell to be checked. A spanning round gives probable pairs only, and each joins its two
    sides for the rest of the cell, so that no cell gives more pairs than members; the last gives every pair left."""
    unique = {r["k"]: r for r in rows}
    members = sorted(unique.values(), key=lambda r: (r["n"], r["k"]))
    sizes = np.array([r["n"] for r in members], np.int64)
    rooms = sizes - np.array([r["rank"] for r in members], np.int64)
    bitmaps = [np.frombuffer(r["sig"], np.uint64) for r in members]
    parent = list(range(len(members)))
    labels: dict[int, int] = {}
    for i, r in enumerate(members):
        parent[i] = labels.setdefault(r["root"], i)
    if len(labels) < 2:
        return
    for i, j, likely in dual_traversal(signature_trees(sizes, rooms, bitmaps), sizes, rooms):
        x, y = members[i], members[j]
        if x["prev"] is not None and x["prev"] == y["prev"]:
            continue
        if x["parts"] is not None and (max(x["band"], y["band"]) != x["cell"] or sorted((x["salt"], y["salt"])) != [x["low"], x["high"]]):
            continue
        a, b = _find(parent, i), _find(parent, j)
        if a != b and (likely or not spanning):
            yield min(x["k"], y["k"]), max(x["k"], y["k"])
            if spanning:
                parent[max(a, b)] = min(a, b)


def _candidates(live: DataFrame, spanning: bool) -> DataFrame:
    """Distinct pairs to check from rows of shingle cells; a cell's rows stay below a few thousand."""
    parts = F.when(F.col("c") > CELL_ROWS, F.ceil(F.col("c") / CELL_ROWS).cast("int"))
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    salt = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    whole = live.withColumn("parts", parts).withColumns({"band": F.when(F.col("parts").isNotNull(), band), "salt": salt})
    split = whole.withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array("band", F.col("band") + 1))))
    split = split.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    cells = split.withColumns({"low": F.least("salt", "other"), "high": F.greatest("salt", "other")}).drop("other")
    key = ["h", "cell", "low", "high"]
    own = cells.select(*key, "k", "n", "prev", "rank", "parts", "band", "salt", "root", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        found: set[tuple[int, int]] = set()
        for _, group in groupby(rows, key=lambda r: tuple(r[c] for c in key)):
            members = list(group)
            if len(members) > 1:
                found.update(_cell_pairs(members, spanning))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
                found = set()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return own.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, index: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole shingle sets of the keys in ``pairs``, read again from the texts of the documents that have them."""
    keys = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    ids = written(index.join(keys, "k").groupBy("k").agg(F.min("doc").alias("doc")).select("doc", F.lit(True).alias("_wanted")).distinct(), "wanted")
    few = ids.count() <= BROADCAST_IDS
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = source.join(F.broadcast(ids) if few else ids.hint("merge"), source["doc"].eqNullSafe(ids["doc"])).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, "text"):
            values, bounds = shingle_sets(part.column(0))
            blobs = [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            found = {k: v for k, v in zip(map(_key, blobs), blobs, strict=True) if v}
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["k", "members"])

    return texts.mapInArrow(run, "k long, members binary").join(keys, "k", "left_semi").dropDuplicates(["k"])


def _key(members: bytes) -> int:
    return xxhash.xxh3_64_intdigest(members) - (1 << 63)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], ["a", "b"])

    left = sets.select(F.col("k").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingle_index(docs: DataFrame, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc, mark, k, n, prefix, sig, mins, at`` per document: its id, hash of its text, key and size of its set, its smallest
    shingles by three other orders, the first shingles in the common order
    (those not in ``hot`` ascending, then the others), of which similar sets share one, and the bitmap.

    ``k`` is null for documents without words; prefix and bitmap stand at the first document of a key in each slice.
    ``at`` numbers the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = shared.value, TaskContext.get().partitionId() << 40
        for part in flat.pieces(batches, "text"):
            values, bounds = shingle_sets(part.column("text"))
            late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values if len(last) else np.zeros(len(values), bool)
            keys, prefixes, bitmaps, mins, seen = [], [], [], [], set()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, size = values[a:b], b - a
                key = _key(own.tobytes()) if size else None
                keys.append(key)
                if not size or key in seen:
                    prefixes.append(None)
                    bitmaps.append(None)
                    mins.append(None)
                    continue
                seen.add(key)
                order = np.concatenate([own[~late[a:b]], own[late[a:b]]])
                prefixes.append(order[: size - (4 * size + 4) // 5 + 1].view(np.int64))
                bitmaps.append(signature(own).tobytes())
                mins.append([int(flat.mix(own ^ seed).min().view(np.int64)) for seed in SEEDS])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("mark"), pa.array(keys, pa.int64()), pa.array(np.diff(bounds)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()),
                 pa.array(mins, pa.list_(pa.int64())), pa.array(np.arange(at, at + part.num_rows))],
                ["doc", "mark", "k", "n", "prefix", "sig", "mins", "at"],
            )
            at += part.num_rows

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, mark long, k long, n long, prefix array<long>, sig binary, mins array<long>, at long")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, mark, k, n, root``: every document with its key and the smallest key that its key reaches by links."""
    spark = docs.sparkSession
    index = written(shingle_index(docs, hot_shingles(docs, text_col), id_col, text_col), "shingle_index")
    stored = _first_of_keys(index.where("prefix is not null"))

    def pairs_of(cells: DataFrame, spanning: bool) -> DataFrame:
        wanted = stored.select("k", "sig").join(cells.select("k").distinct(), "k", "left_semi")
        return _candidates(cells.join(wanted, "k"), spanning)

    def linked(pairs: DataFrame) -> DataFrame:
        return written(_verified(pairs, _sets(docs, index, pairs, id_col, text_col)), "links")

    def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.drop("root").join(roots, rows["k"] == roots["node"], "left").withColumn("root", F.coalesce("root", "k")).drop("node")

    cell = Window.partitionBy("h")
    size = F.count(F.lit(1)).over(cell)
    mins = stored.select("k", "n", F.explode("mins").alias("h")).withColumns({"c": size, "_k0": F.min("k").over(cell), "_k1": F.max("k").over(cell)})
    starts = mins.where("_k0 <> _k1").select("h", "k", "n", F.lit(None).cast("long").alias("prev"), F.lit(0).alias("rank"), "c", F.col("k").alias("root"))
    checked = written(pairs_of(written(starts, "first_cells"), True), "pairs")
    links = linked(checked)
    roots = written(components(links), "roots")

    before = lambda h, i: F.struct(h.alias("h"), F.when(i > 0, F.get(F.col("prefix"), i - 1).bitwiseAND(0x7FFFFFFF)).alias("prev"), i.alias("rank"))
    tokens = labelled(stored, roots).select("k", "n", "root", F.inline(F.transform("prefix", before)))
    measured = tokens.withColumns({"c": size, "_r0": F.min("root").over(cell), "_r1": F.max("root").over(cell), "_p": F.count("prev").over(cell), "_p0": F.min("prev").over(cell), "_p1": F.max("prev").over(cell), "_n0": F.min("n").over(cell)})
    some_room = "9 * (n - rank) >= 4 * (n + greatest(_n0, 0.8D * n))"
    mixed = measured.where(f"_r0 <> _r1 AND (_p < c OR _p0 <> _p1) AND {some_room}")
    live = written(_with_roots(mixed.select("h", "k", "n", "prev", "rank", "c", "root")), "live")

    # Cells of many roots first give the few pairs that would join them, and are then told what these link.
    plain, crowded = live.where(F.col("roots") <= MANY_ROOTS), live.where(F.col("roots") > MANY_ROOTS)
    for _ in range(SPANNING_ROUNDS):
        tried = written(pairs_of(crowded, True).join(checked, ["a", "b"], "left_anti"), "pairs") if not crowded.isEmpty() else None
        more = linked(tried) if tried is not None and not tried.isEmpty() else None
        if more is None or more.isEmpty():
            break
        checked, links = checked.unionByName(tried), links.unionByName(more)
        roots = written(components(links), "roots")
        again = labelled(crowded, roots).withColumns({"_r0": F.min("root").over(cell), "_r1": F.max("root").over(cell)})
        crowded = written(again.where("_r0 <> _r1").drop("_r0", "_r1"), "crowded")

    last = written(pairs_of(plain.unionByName(crowded), False).join(checked, ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        more = linked(last)
        roots = roots if more.isEmpty() else written(components(links.unionByName(more)), "roots")
    named = index.select("doc", "mark", "k", "n")
    named = named.join(roots, named["k"] == roots["node"], "left").withColumn("root", F.coalesce("root", "k"))
    return named


def _first_of_keys(rows: DataFrame) -> DataFrame:
    """One row of each key: what more slices have of a set that is in many documents goes before cells are formed."""
    first = written(rows.groupBy("k").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k", "first"), "first")
    again = written(rows.select("k", "at").join(first, "k").where("at <> first").select("at"), "again")
    few = again.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(again) if few else again.hint("merge"), "at", "left_anti")


def _with_roots(cells: DataFrame) -> DataFrame:
    """The rows with the number of different roots in their cell, in the partitioning that they have."""
    by_root = Window.partitionBy("h").orderBy("root")
    return cells.withColumn("_nth", F.dense_rank().over(by_root)).withColumn("roots", F.max("_nth").over(Window.partitionBy("h"))).drop("_nth")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row: the smallest id reachable by links of Jaccard 0.8 or more.

    A set is a document's distinct 5-word shingles (lower-case A-Z; fewer words: the sequence as a whole). Null and
    empty texts, and texts of white space, have an empty set and link with nothing. Rows with equal sets are linked;
    repeated ids and null ids are rows like others, and a null id is never a component's name unless all are null.
    Shingles and sets are compared by 64-bit hashes. Other columns are not read.

    Sets that share a shingle form a cell. In a cell a signature tree is traversed against itself, and the pairs that
    it leaves are checked with the whole sets. Cells too large for a task are split by size bands and salts without
    losing a pair. The first round takes the sets' smallest shingles by three orders and links clusters by few pairs.
    Then come cells in which similar sets meet for sure: they share one of their first shingles in a common order, rare
    before frequent. Cells of more than MANY_ROOTS components first give spanning pairs only, at most one a
    member; the last round is complete and checks every pair between different components that the bitmaps leave.
    """
    named = _labelled(docs, id_col, text_col)
    smallest = written(named.where("root is not null").groupBy("root").agg(F.min("doc").alias("least")), "names")
    return named.join(smallest, "root", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every component, and those without words, with all their columns."""
    named = _labelled(docs, id_col, text_col)
    rank = F.struct(F.col("doc").isNull().alias("null"), "doc", "mark")
    first = written(named.where("root is not null").groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"), "names")
    verdicts = named.join(first, "root", "left").select("doc", "mark", (F.col("first").isNull() | (F.col("first") == rank)).alias("kept"))
    return keep_rows(docs, verdicts, id_col, text_col)
