"""Benchmark decontamination: a generalised suffix automaton of the test items, and documents streamed through it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracewell.llm import flat

BLOCK_BYTES = 16 << 20
SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])


class Automaton:
    """Generalised suffix automaton of word sequences: one state per set of equal end positions over all items.

    ``window`` is the length that makes an occurrence count; an item with fewer words counts as a whole.
    """

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        states = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.top = [0] * len(states)
        for v in states:
            if self.length[v] >= window:
                self.top[v] = v if self.length[self.link[v]] < window else self.top[self.link[v]]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.items.setdefault(self.top[v], set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        self.short_up = [-1] * len(states)
        for v in states:
            self.short_up[v] = v if v in self.short else self.short_up[self.link[v]] if v else -1

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is not None:
            return self._split(last, w, there)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings, which end in more places."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first, end, items) of the longest match ending at each word, where it holds a window."""
        v = length = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                length += 1
            if length >= self.window:
                yield i + 1 - length, i + 1, self.items[self.top[v]]
            s = self.short_up[v]
            while s > 0:
                for size, found in self.short[s].items():
                    if s != v or length >= size:
                        yield i + 1 - size, i + 1, found
                s = self.short_up[self.link[s]]


class Index:
    """The automaton of a block of items, with hashes that let most words of a document pass by unread."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        data, offsets = flat.texts(pa.array([t for _, t in rows], pa.string()))
        data = flat.LOWER[data]
        start, end, first = flat.words(data, offsets, flat.ALPHANUMERIC)
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(found))}
        items = [(item, [self.ids[w] for w in found[a:b]]) for (item, _), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True)]
        items = [(item, words) for item, words in items if words]
        self.automaton = Automaton(items, window)
        self.shortest = min([window, *(len(words) for _, words in items)])
        hashes = flat.span_hash(data, start, end)
        self.words = np.unique(hashes)
        self.passing = np.zeros(1 << 20, bool)
        self.passing[self.words >> np.uint64(44)] = True
        inside = np.setdiff1d(np.arange(len(start) - 1), first - 1)
        self.pairs = np.unique(flat.mix(hashes[inside] * flat.MIX + hashes[inside + 1])) if len(inside) else self.words[:0]

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Longest runs of words in which every word and every pair of neighbours stands in some item."""
        known = np.flatnonzero(self.passing[hashes >> np.uint64(44)])
        known = known[_member(hashes[known], self.words)]
        if not len(known):
            return []
        joined = np.zeros(len(known), bool)
        joined[1:] = np.diff(known) == 1
        joined[1:] &= ~np.isin(known[1:], first)
        again = np.flatnonzero(joined)
        with np.errstate(over="ignore"):
            pair = flat.mix(hashes[known[again] - 1] * flat.MIX + hashes[known[again]])
        joined[again] = _member(pair, self.pairs)
        start = np.flatnonzero(~joined)
        size = np.diff(np.append(start, len(known)))
        long = size >= self.shortest
        return list(zip(known[start[long]].tolist(), (known[start[long]] + size[long]).tolist(), strict=True))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _blocks(items: DataFrame, item_id: str, text: str) -> list:
    """Broadcast blocks of items of at most about BLOCK_BYTES each; a worker holds the automaton of one at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // BLOCK_BYTES + 1
    out = []
    for k in range(count):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else rows
        out.append(spark.sparkContext.broadcast(sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
    return out


_loaded: dict[tuple, tuple[Index, list]] = {}


def _index(block, window: int) -> Index:
    rows = block.value
    if (id(rows), window) not in _loaded:
        _loaded.clear()
        _loaded[id(rows), window] = (Index(rows, window), rows)
    return _loaded[id(rows), window][0]


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, hit_items`` and ``hit_spans``, byte ranges of the text.

    Words are runs of ASCII letters and digits and non-ASCII bytes, lower case. A window is ``window`` consecutive words of an item; an item of fewer words is one
    window as a whole, and an item without words none. A word is hit inside any occurrence of a window; touching
    occurrences are one span. Null texts have no words. Items without a text are ignored; the words of
    items without an id count as hit, but name no item; repeated items count once per id. Columns of ``docs`` named like a new one are replaced.

    Items are broadcast in blocks of a checked size. Words and neighbouring pairs that stand in no item are passed
    over by hash; what remains goes word by word through the automaton, so a hash never decides a match.
    """
    blocks = _blocks(items, item_id, item_text)
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.LongType())), T.StructField("hit_spans", T.ArrayType(SPAN)),
    ]
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    def compute(column: pa.Array) -> list[pa.Array]:
        data, offsets = flat.texts(column)
        data = flat.LOWER[data]
        raw = data.tobytes()
        start, end, first = flat.words(data, offsets, flat.ALPHANUMERIC)
        hashes = flat.span_hash(data, start, end)
        change = np.zeros(len(start) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(column))]
        for block in blocks:
            index = _index(block, window)
            for a, b in index.runs(hashes, first):
                doc = int(np.searchsorted(first, a, "right")) - 1
                words = [index.ids.get(raw[s:e], -1) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                for x, y, items_there in index.automaton.matches(words):
                    change[a + x] += 1
                    change[a + y] -= 1
                    found[doc] |= items_there
        hit = np.cumsum(change[:-1]) > 0
        n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        for doc in np.flatnonzero(n_hit).tolist():
            own = np.flatnonzero(hit[first[doc] : first[doc + 1]]) + first[doc]
            cut = np.flatnonzero(np.diff(own) > 1)
            for x, y in zip(own[np.append(0, cut + 1)].tolist(), own[np.append(cut, len(own) - 1)].tolist(), strict=True):
                spans[doc].append({"first": int(start[x] - offsets[doc]), "end": int(end[y] - offsets[doc])})
        return [
            pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(s - {None}) for s in found], pa.list_(pa.int64())), pa.array(spans, pa.list_(span)),
        ]

    return flat.appended(docs, text_col, fields, compute)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.0, text_col: str = "text", **names) -> DataFrame:
    """The documents without test items, in their own columns: a document of which a greater share of words is hit
    than ``max_coverage`` goes as a whole, and the hit spans of the others are cut out of their texts.

    With the default of 0 every document with a hit goes; documents without one are unchanged.
    """
    before = docs.columns
    rest = [F.col(f"`{c}`") for c in before if c != text_col] or [F.lit(True)]
    seen = contamination(docs.select(text_col, F.struct(*rest).alias("_rest")), items, window, text_col, **names)
    kept = seen.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    data, spans = F.encode(F.col(text_col), "UTF-8"), F.col("hit_spans")
    inner = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    outer = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.octet_length(F.col(text_col))))
    parts = F.transform(F.arrays_zip(inner.alias("a"), outer.alias("b")), lambda x: F.decode(F.substring(data, x["a"] + 1, x["b"] - x["a"]), "UTF-8"))
    cleaned = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text_col))
    return kept.withColumn("_clean", cleaned).select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in before])
