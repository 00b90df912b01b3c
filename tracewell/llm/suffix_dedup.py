"""Repeated byte strings: Burrows-Wheeler intervals grown breadth first by backward extension, up to a length."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm import flat
from tracewell.scale import spread_join
from tracewell.session import work_path, written

GRAM = 32
BLOCK_BYTES = 2 << 20
SEARCH_BYTES = 256 << 10
INDEX_BYTES = 1 << 20
PLACE_BITS = 28
STEP = 16

REGION = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("rk", pa.int64())])
RUN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the rotations of ``text`` in order of their first ``depth`` bytes at least, by prefix doubling."""
    n = len(text)
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | np.roll(text, -i)
    rank, order = _ranked(first)
    known = 8
    while known < depth and int(rank[order[-1]]) < n - 1:
        # Only places that still share their rank are sorted again, by the rank of what follows them.
        tied = np.zeros(n, bool)
        same = rank[order[1:]] == rank[order[:-1]]
        tied[1:] = same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        places = order[at]
        key = rank[places] * n + rank[(places + known) % n]
        again = np.argsort(key)
        order[at] = places[again]
        fresh = np.ones(n, bool)
        fresh[1:] = ~same
        key = key[again]
        fresh[at[1:]] |= key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        known *= 2
    return order


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(True, np.diff(key[order]) != 0)) - 1
    return rank, order


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Per place in ``order`` whether it shares at least ``least`` bytes with the place before it.

    The whole order is the interval of the empty string. Level by level, every interval of a string w is extended
    backward by each byte c before its members, which gives the interval of cw; where that interval ends, the common
    prefix is as long as w if no shorter one was found there. Only intervals that settle an end go on. Common
    prefixes thus appear by increasing value, and the search stops at ``least``: what is unsettled then is longer.

    Members that follow each other and have the same byte before them stay together, so an interval is extended by
    the runs of equal bytes in it, not member by member; most intervals have one run and need one look-up.
    """
    n = len(text)
    before = text[order - 1]
    step = np.empty(n, np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    first = np.sort(before)
    byte_opens = np.concatenate([[True], first[1:] != first[:-1]])
    run_opens = np.concatenate([[True], before[1:] != before[:-1]])
    run = np.cumsum(run_opens, dtype=np.int32) - 1
    run_low = np.append(np.flatnonzero(run_opens), n)
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        a, b = run[low], run[high - 1]
        mixed = np.flatnonzero(a != b)
        new_low = step[low].astype(np.int64)
        new_high = new_low + (high - low)
        if len(mixed):
            count = b[mixed] - a[mixed] + 1
            owner = np.repeat(mixed, count)
            r = flat.ranges(a[mixed], count)
            start = np.maximum(run_low[r], low[owner])
            size = np.minimum(run_low[r + 1], high[owner]) - start
            moved = step[start]
            by_step = np.argsort(moved)
            moved, size, owner = moved[by_step], size[by_step], owner[by_step]
            joined = (moved[1:] == moved[:-1] + size[:-1]) & (owner[1:] == owner[:-1]) & ~byte_opens[moved[1:]]
            opens = np.flatnonzero(np.concatenate([[True], ~joined]))
            ends = np.append(opens[1:], len(moved)) - 1
            alone = np.ones(len(low), bool)
            alone[mixed] = False
            new_low = np.concatenate([new_low[alone], moved[opens]])
            new_high = np.concatenate([new_high[alone], moved[ends] + size[ends]])
        fresh = ~settled[new_high]
        if level == 0:
            settled[new_high] = True
            low, high = new_low, new_high
        else:
            low, high = new_low[fresh], new_high[fresh]
            settled[high] = True
        if not len(low):
            break
    return ~settled[:n]


def repeated_starts(texts: list[bytes], counts: list[int], copies: list[int], least: int) -> list[np.ndarray]:
    """Per text, which of its first ``counts`` places start a string of ``least`` bytes that starts elsewhere too;
    ``copies`` says how often a text stands in the corpus."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    order = sorted_rotations(whole, least)
    group = np.cumsum(~common_prefixes(whole, order, least))
    weight = np.zeros(len(whole), np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    for a, n, m in zip(bounds[:-1].tolist(), counts, copies, strict=True):
        weight[a : a + n] = m
    total = np.bincount(group, weight[order])
    repeated = np.zeros(len(whole), bool)
    repeated[order] = total[group] >= 2
    return [repeated[a : a + n] for a, n in zip(bounds[:-1].tolist(), counts, strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _regions(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, first place, places, fingerprint) of runs of places whose next ``least`` bytes have the same anchor:
    the GRAM bytes with the smallest hash among them, the leftmost of several. Equal strings have equal anchors."""
    window = least - GRAM + 1
    if len(data) < least:
        return
    prefix = flat.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = flat.window_hash(prefix, at, at + GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    smallest = (grams & ~mask) | at.astype(np.uint64)
    width = 1
    while 2 * width <= window:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    if window > width:
        smallest = np.minimum(smallest[: len(smallest) - (window - width)], smallest[window - width :])
    anchor = (smallest & mask).astype(np.int64)
    places = np.maximum(np.diff(offsets) - least + 1, 0)
    start = flat.ranges(offsets[:-1], places)
    doc = np.repeat(np.arange(len(places)), places)
    own = anchor[start]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(doc) != 0)])) if len(own) else np.empty(0, np.int64)
    count = np.diff(np.append(opens, len(own)))
    fp = grams[own[opens]].view(np.int64)
    yield from zip(doc[opens].tolist(), start[opens].tolist(), count.tolist(), fp.tolist(), strict=True)


def _indexed(docs: DataFrame, least: int) -> DataFrame:
    """Per row a number of its own in ``at``, its text, length and hash, and the regions of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in flat.pieces(batches, "text", INDEX_BYTES):
            data, offsets = flat.texts(part.column("text"))
            raw = data.tobytes()
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for doc, start, n, fp in _regions(data, offsets, least):
                rk = xxhash.xxh3_64_intdigest(raw[start : start + n + least - 1], n & 0xFFFF) - (1 << 63)
                found[doc].append({"start": start - int(offsets[doc]), "n": n, "fp": fp, "rk": rk})
            sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + part.num_rows)), part.column("doc"), part.column("text"), pa.array(np.diff(offsets)), pa.array(sha), pa.array(found, pa.list_(REGION))],
                ["at", "doc", "text", "n_bytes", "sha", "regions"],
            )
            at += part.num_rows

    return docs.mapInArrow(run, "at long, doc long, text string, n_bytes long, sha binary, regions array<struct<start long, n long, fp long, rk long>>")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once in buckets of ``key``, so that joins by it never move the stored texts."""
    spark = df.sparkSession
    name = f"suffix_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", work_path(spark, "texts")).option("compression", "zstd")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def _cut_texts(texts: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, "text"):
            out = []
            for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                raw = text.encode()
                out += [(c["fp"], c["rk"], c["n"], c["m"], raw[c["start"] : c["start"] + c["n"] + least - 1]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fp", "rk", "n", "m", "region"])

    return texts.select("text", "cuts").mapInArrow(run, "fp long, rk long, n long, m long, region binary").dropDuplicates(["fp", "rk"])


def _searched(regions: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def search() -> pa.RecordBatch:
            masks = repeated_starts([r["region"] for r in held], [r["n"] for r in held], [r["m"] for r in held], least)
            out = [(r["fp"], r["rk"], [{"first": a, "end": b} for a, b in _runs(m)]) for r, m in zip(held, masks, strict=True)]
            fp, rk, runs = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(rk), pa.array(runs, pa.list_(RUN))], ["fp", "rk", "runs"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= min(SEARCH_BYTES, BLOCK_BYTES) and r["fp"] != last:
                    yield search()
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r["region"]), r["fp"]
        if held:
            yield search()

    ordered = regions.repartition("fp").sortWithinPartitions("fp", "rk")
    return ordered.mapInArrow(run, "fp long, rk long, runs array<struct<first long, end long>>")


def _pieces(regions: DataFrame, least: int) -> DataFrame:
    """Each region cut where the anchor's offset in the places' strings is a multiple of STEP: ``n`` places from
    ``first``, a hash ``h`` of the bytes that every string with such an offset shares, and a hash ``q`` of all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, "region", INDEX_BYTES):
            data, offsets = flat.texts(part.column("region"))
            fp, n = part.column("fp").to_numpy(), part.column("n").to_numpy()
            prefix, raw, start = flat.prefix_hash(data), data.tobytes(), offsets[:-1]
            at = np.arange(len(data) - GRAM + 1)
            own = np.repeat(fp, np.diff(offsets))[: len(at)]
            found = np.flatnonzero(flat.window_hash(prefix, at, at + GRAM).view(np.int64) == own)
            anchor = found[np.searchsorted(found, start)]
            most = anchor - start
            low = (most - n + 1) // STEP
            count = most // STEP - low + 1
            of, a = np.repeat(np.arange(len(n)), count), flat.ranges(low, count) * STEP
            first, end = np.maximum(most[of] - a - STEP + 1, 0), np.minimum(most[of] - a + 1, n[of])
            h = flat.window_hash(prefix, anchor[of] - a, anchor[of] - a + least - STEP + 1).view(np.int64)
            bounds = zip((start[of] + first).tolist(), (start[of] + end + least - 1).tolist(), strict=True)
            q = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in bounds], np.uint64).view(np.int64)
            rk, m = part.column("rk").to_numpy()[of], part.column("m").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fp[of], rk, h, q, first, end - first, m)], ["fp", "rk", "h", "q", "first", "n", "m"])

    return regions.mapInArrow(run, "fp long, rk long, h long, q long, first long, n long, m long")


def _strings(regions: DataFrame, least: int) -> DataFrame:
    """Every place of the ``parts`` of the regions with a 128-bit hash of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.pieces([batch], "region", INDEX_BYTES):
                out = []
                for r in part.to_pylist():
                    raw = r["region"]
                    out += [(r["fp"], r["rk"], r["m"], i, xxhash.xxh3_128_digest(raw[i : i + least])) for p in r["parts"] for i in range(p["first"], p["first"] + p["n"])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fp", "rk", "m", "first", "s"])

    return regions.mapInArrow(run, "fp long, rk long, m long, first long, s binary")


def _joined_runs(hits: DataFrame) -> DataFrame:
    """One row per region with its runs; those that touch become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = []
            for parts in batch.column("runs").to_pylist():
                mask = np.zeros(max(p["end"] for p in parts), bool)
                for p in parts:
                    mask[p["first"] : p["end"]] = True
                runs.append([{"first": a, "end": b} for a, b in _runs(mask)])
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("rk"), pa.array(runs, pa.list_(RUN))], ["fp", "rk", "runs"])

    grouped = hits.groupBy("fp", "rk").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    return grouped.mapInArrow(run, "fp long, rk long, runs array<struct<first long, end long>>")


def _counted(regions: DataFrame, least: int) -> DataFrame:
    """The repeated places of regions whose fingerprint has too many bytes for one task, with no sorting of texts.

    Equal strings have their anchor at equal offsets, so strings whose offset is in a range of STEP share the bytes
    around the anchor that each string of the range has. Pieces of regions are grouped by these bytes: one that is
    alone is not repeated, a group of copies is repeated as a whole, and of the others every string is counted.
    Groups are only ever aggregated and joined, so no task holds one.
    """
    pieces = written(_pieces(regions, least), "pieces")
    groups = pieces.groupBy("fp", "h").agg(F.sum("m").alias("total"), (F.min("q") == F.max("q")).alias("same")).where("total > 1")
    judged = written(spread_join(pieces, written(groups.select("fp", "h", "same"), "groups"), ["fp", "h"], "inner"), "judged")
    parts = judged.where("NOT same").groupBy("fp", "rk").agg(F.collect_list(F.struct("first", "n")).alias("parts"))
    strings = written(_strings(regions.join(parts, ["fp", "rk"]).select("fp", "rk", "m", "region", "parts"), least), "strings")
    again = written(strings.groupBy("s").agg(F.sum("m").alias("total")).where("total > 1").select("s"), "again")
    single = spread_join(strings, again, ["s"], "left_semi").select("fp", "rk", "first", (F.col("first") + 1).alias("end"))
    return _joined_runs(judged.where("same").select("fp", "rk", "first", (F.col("first") + F.col("n")).alias("end")).unionByName(single))


def _removed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, "text"):
            out = []
            for doc, text, spans in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                mask = np.zeros(len(raw), np.int64)
                for s in spans:
                    mask[s["first"]] += 1
                    if s["end"] < len(raw):
                        mask[s["end"]] -= 1
                gone = np.cumsum(mask) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, len(raw), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the bytes that are left (null where
    nothing is removed): every byte goes that a string of ``least`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes, null is empty, strings never cross documents and are judged on the input. Repeated rows
    are documents like others, so their texts of ``least`` bytes and more go. Other columns are not read.

    Every place belongs to the region of its string's anchor, so equal strings start in regions of one fingerprint.
    Regions are folded to distinct ones with a count (by two 64-bit hashes) before they move. A fingerprint with one
    region in all is not repeated; one whose region has only copies is repeated as a whole; the texts of the
    others are fetched once, and blocks of about SEARCH_BYTES of them, or one fingerprint of up to BLOCK_BYTES, are
    sorted and searched; a fingerprint that has more bytes by itself is split and counted instead, so a block never
    exceeds twice that size. Texts are stored in buckets of a row number, so that only places, regions and spans are
    shuffled, at every size alike.
    """
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    index = _bucketed(_indexed(docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")), least), "at")
    places = index.select("at", F.inline("regions"))
    first = F.min(F.struct("at", "start", "n"))
    folded = places.groupBy("fp", "rk").agg(F.count(F.lit(1)).alias("m"), first.alias("first"))
    by_fp = Window.partitionBy("fp")
    large = F.sum(F.col("first.n") + (least - 1)).over(by_fp) > BLOCK_BYTES
    shared = folded.withColumns({"kinds": F.count(F.lit(1)).over(by_fp), "large": large}).where("kinds > 1 OR m > 1")
    shared = written(shared.select("fp", "rk", "m", "kinds", "large", "first.*"), "shared")

    def fetched(wanted: DataFrame) -> DataFrame:
        cuts = wanted.groupBy("at").agg(F.collect_list(F.struct("start", "n", "fp", "rk", "m")).alias("cuts"))
        return _cut_texts(index.join(cuts.hint("merge"), "at"), least)

    found = _searched(fetched(shared.where("kinds > 1 AND NOT large")), least).where(F.size("runs") > 0)
    oversize = shared.where("kinds > 1 AND large")
    if not oversize.isEmpty():
        found = found.unionByName(_counted(written(fetched(oversize), "oversize"), least))
    copied = shared.where("kinds = 1").select("fp", "rk", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("end"))).alias("runs"))
    hits = written(found.unionByName(copied), "hits")
    span = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["end"] + (least - 1)).alias("end")))
    spans = places.join(hits, ["fp", "rk"]).select("at", F.explode(span).alias("span"))
    marked = written(spans.groupBy("at").agg(F.collect_list("span").alias("spans")), "spans")
    dirty = _removed(index.join(marked.hint("merge"), "at").select("doc", "text", "spans"))
    clean = index.join(marked.select("at").hint("merge"), "at", "left_anti").select(
        "doc", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return dirty.unionByName(clean).withColumnRenamed("doc", id_col)
