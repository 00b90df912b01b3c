"""Token ids of many texts with a public tokenizer: distinct pieces are encoded once and put together in arrays."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tracewell.llm import flat

MOST_CACHED = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x0A]] = True
GRAPH = np.zeros(256, bool)
GRAPH[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PUNCTUATION = GRAPH & ~LETTER
PUNCTUATION[[0x27, *range(0x30, 0x3A)]] = False


class PieceEncoder:
    """Encodes texts exactly as the tokenizer does with whole texts, but each distinct piece of text only once.

    Texts are cut only where the tokenizer's own pre-tokenizer always cuts: before a space or line feed that
    follows a visible character, and between a letter and ASCII punctuation other than the apostrophe. Cuts next to
    characters of other blocks are left out, which only makes pieces longer. ``fold`` is for tokenizers that drop
    white space and case: the pieces then lose one leading space and their A-Z, so that more of them are equal.
    New pieces of ASCII letters go straight to the tokenizer's model, others through all its steps.
    Known pieces are kept with their bytes, up to ``most`` of them; then the memory starts anew. They are found by
    64-bit hash, and a piece gets the ids of a known one only if their bytes are equal.

    Strings of the tokenizer's special tokens are found first, as the library does by default, and are pieces with
    ids of their own; a text before or after one is encoded like a text by itself. A tokenizer with added tokens
    that are matched in any other way (words, stripped spaces, normalized or not special) gets whole texts.
    """

    def __init__(self, path: str, fold: bool = False, most: int = MOST_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = any(t.single_word or t.lstrip or t.rstrip or t.normalized or not t.special for t in added.values())
        self.special = {} if self.whole else {t.content.encode(): i for i, t in added.items() if t.content}
        # The leftmost string counts, and the longest of those at one place.
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        # Special strings are taken out of the pieces, and what folding makes equal to one is ordinary text.
        self.tokenizer.encode_special_tokens = not self.whole
        self.fold = fold and not self.whole
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.bits = 16
        self.slots, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.hashes, self.entries = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.place, self.size, self.bytes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1: an open-addressing table, probed for all hashes at once."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        slot = self.slots[at]
        out = np.where(slot == hashes, self.entry[at], -1)
        left = np.flatnonzero((slot != hashes) & (slot != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            slot = self.slots[at[left]]
            out[left] = np.where(slot == hashes[left], self.entry[at[left]], -1)
            left = left[(slot != hashes[left]) & (slot != 0)]
        return out

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Adds distinct hashes; of several that want a slot one gets it, and the others try the next."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            own, where = hashes[left], at[left]
            empty = self.slots[where] == 0
            self.slots[where[empty]] = own[empty]
            won = empty & (self.slots[where] == own)
            self.entry[where[won]] = entries[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of every piece, in order; each text that isn't empty starts one."""
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        if len(data) > 1 and not self.whole:
            # A two-byte letter from À to ÿ, at its first and its second byte; × and ÷ are no letters.
            first = data[:-1] == 0xC3
            latin = first & (data[1:] != 0x97) & (data[1:] != 0xB7)
            opens = LETTER[data]
            opens[:-1] |= latin
            closes = LETTER[data]
            closes[1:] |= latin
            starts[1:-1] |= SPACE[data[1:]] & (GRAPH[data[:-1]] | closes[:-1])
            punctuation = PUNCTUATION[data]
            starts[1:-1] |= (closes[:-1] & punctuation[1:]) | (punctuation[:-1] & opens[1:])
        return np.flatnonzero(starts[:-1])

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the special tokens' strings; none crosses texts."""
        raw = data.tobytes() if self.special else b""
        found = []
        if any(t in raw for t in self.special):
            bounds = offsets.tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                found += [(*m.span(), self.special[m.group()]) for m in self.pattern.finditer(raw, a, b)]
        out = np.array(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and len+1 offsets of the texts in them."""
        data, offsets = flat.texts(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        opens, closes, special = self._specials(data, offsets)
        if self.fold:
            data = flat.LOWER[data]
        start = self.cuts(data, offsets)
        if len(opens):
            inside = np.searchsorted(opens, start, "right") - 1
            start = np.union1d(start[(inside < 0) | (start >= closes[inside])], np.concatenate([opens, closes[closes < len(data)]]))
        given = np.full(len(start), -1)
        given[np.searchsorted(start, opens)] = special
        end = np.append(start[1:], len(data))
        of_text = np.searchsorted(start, offsets)
        if self.fold:
            start = start + (SPACE[data[start]] & (end - start > 1))
        hashes = flat.span_hash(data, start, end) | np.uint64(1)
        # A special token's piece is told from ordinary text of the same bytes.
        hashes[given >= 0] ^= flat.MIX - np.uint64(1)
        where = self._find(hashes)
        missed = np.flatnonzero(where < 0)
        if len(missed):
            if len(self.hashes) + len(missed) > self.most and len(self.hashes):
                self._forget()
                missed = np.arange(len(hashes))
            own, example = np.unique(hashes[missed], return_index=True)
            example = missed[example]
            new = self._learn(data, start[example], end[example], given[example])
            self._remember(own, new)
            where[missed] = self._find(hashes[missed])
        size = end - start
        equal = self.size[where] == size
        equal[equal] = flat.same_spans(data, start[equal], self.bytes, self.place[where[equal]], size[equal])
        other = np.flatnonzero(~equal)
        if len(other):
            # Another piece has the hash: these get ids of their own, which no hash leads to.
            where[other] = self._learn(data, start[other], end[other], given[other])
        count = self.count[where]
        ids = self.ids[flat.ranges(self.first[where], count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[of_text]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Encodes pieces and returns the entries that have their ids; ``given`` has those of special tokens, else -1."""
        raw, model = data.tobytes(), self.tokenizer.model
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            if given[i] >= 0:
                found[i] = [int(given[i])]
            elif not self.whole and (word[1:] if word[:1] == b" " and not self.fold else word).isalpha():  # only ASCII letters: one word for the model as it is
                found[i] = [t.id for t in model.tokenize(word.decode().replace(" ", "Ġ"))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for one in found for i in one), np.uint32, int(count.sum()))
        size, known = end - start, len(self.count)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.place = np.concatenate([self.place, len(self.bytes) + np.cumsum(size) - size])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        self.size, self.bytes = np.concatenate([self.size, size]), np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        return np.arange(known, known + len(words), dtype=np.int32)

    def _remember(self, own: np.ndarray, entries: np.ndarray) -> None:
        """Lets distinct hashes lead to their entries."""
        self.hashes, self.entries = np.concatenate([self.hashes, own]), np.concatenate([self.entries, entries])
        if 2 * len(self.hashes) > len(self.slots):
            self.bits = (4 * len(self.hashes)).bit_length()
            self.slots, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            own, entries = self.hashes, self.entries
        self._insert(own, entries)


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, fold: bool = False, most: int = MOST_CACHED) -> PieceEncoder:
    """One encoder per worker process; its memory of pieces serves all tasks that the process runs."""
    if (path, fold, most) not in _encoders:
        _encoders[path, fold, most] = PieceEncoder(path, fold, most)
    return _encoders[path, fold, most]


def encoded(batches: Iterator[pa.RecordBatch], path: str, fold: bool, end_id: int, text: str = "text", most: int = MOST_CACHED):
    """Slices of the rows, each with all ids of its texts (``end_id`` after each text) and the texts' offsets."""
    encode = encoder(path, fold, most).encode
    for part in flat.pieces(batches, text, flat.SMALL_BYTES):
        ids, offsets = encode(part.column(text))
        n = len(offsets) - 1
        whole = np.insert(ids, offsets[1:], np.uint32(end_id))
        yield part, whole, offsets + np.arange(n + 1)
