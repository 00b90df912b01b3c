"""Toxicity by weak supervision: many voters, a generative label model of their votes, and a linear classifier of its labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracewell.llm import flat
from tracewell.session import written

SAMPLE_ROWS = 20_000
CANDIDATES, TERMS, MINED = 65_536, 2_048, 16
ROUNDS, SMOOTHING, LEAST_LINK = (6, 4, 4), 1.0, 0.01
PATTERN_ROWS, SKETCHES, SKETCH_WORDS = 16_384, 4, 5
BEGINNINGS = (4, 5, 6, 7, 8, 10, 12)
SALTS = flat.mix(np.arange(max(BEGINNINGS) + 1, dtype=np.uint64) + flat.MIX)
STRONG, RARE = np.log(20), np.log(4)
TOXIC, CLEAN = 1, 2

#: Common insults of four languages.
INSULTS = {
    "english": "clown coward creep disgusting dumb filth fool freak garbage idiot jerk liar loser moron pathetic scum stupid trash worthless",
    "german": "abschaum blödmann dumm erbärmlich idiot müll trottel versager wertlos widerlich",
    "french": "abruti crétin débile idiot imbécile minable ordure pathétique raclure",
    "spanish": "asqueroso basura escoria estúpido idiota imbécil inútil patético payaso tonto",
}
#: Forms of address.
ADDRESS = "you your du dein ihr tu toi vous usted eres"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MASK = np.zeros(256, bool)
MASK[np.frombuffer(b"*#@$%", np.uint8)] = True

PATTERNS = ["addressed", "shouting", "exclaiming", "masked", "drawn out", "several", "plain"]
NUMBERS = ["strong hits", "hits", "distinct hits", "strong share", "share", "hits of fixed lists", "shouted share", "exclamations", "masked letters", "words"]


class Words:
    """Words (runs of letters and non-ASCII bytes, lower-case A-Z) of a slice of texts, and their terms by 64-bit hash: the
    whole word and its beginnings of the lengths in BEGINNINGS, in bytes."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat.texts(column)
        self.low = flat.LOWER[self.data]
        self.start, self.end, self.first = flat.words(self.low, self.offsets, LETTER)
        self.size = self.end - self.start
        self.bytes = flat.eight_bytes(self.low)
        self.chunk = self.bytes[self.start]
        self.lead = (self.chunk & flat.LOW_BYTES[np.minimum(self.size, 3)]).astype(np.int64)
        self.doc = flat.owners(self.first)

    def terms(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their terms) of the words in ``some``, for one kind of term at a time."""
        for k in BEGINNINGS:
            own = some[self.size[some] > k]
            keys = flat.mix(self.chunk[own] & flat.LOW_BYTES[min(k, 8)] ^ SALTS[k])
            if k > 8:
                keys = flat.mix(keys ^ self.bytes[self.start[own] + 8] & flat.LOW_BYTES[k - 8])
            yield own, keys
        own = some[self.size[some] > 2]
        yield own, flat.span_hash(self.low, self.start[own], self.end[own])

    def found(self, terms: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, place in ``terms``) wherever a word has one of the terms, which are in ascending order and start with ``leads``."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        opens = np.zeros(1 << 24, bool)
        opens[leads] = True
        words, places = [], []
        for own, keys in self.terms(np.flatnonzero(opens[self.lead])):
            at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
            hit = terms[at] == keys
            words.append(own[hit])
            places.append(at[hit])
        return np.concatenate(words), np.concatenate(places)


@dataclass
class Term:
    """A term of a lexicon: its hash, the first three bytes, and whether one occurrence is enough for a vote."""

    key: int
    lead: int
    strong: bool


@dataclass
class Voters:
    """Lexicons by voter: the terms of all in ascending order of their keys; ``fixed`` voters come last."""

    keys: np.ndarray
    leads: np.ndarray
    strong: np.ndarray
    voter: np.ndarray
    mined: int
    fixed: list[str] = field(default_factory=lambda: list(INSULTS))

    @property
    def names(self) -> list[str]:
        return [*[f"mined {i}" for i in range(self.mined)], *self.fixed, *PATTERNS]


def listed_terms(words: str) -> list[Term]:
    """The whole words of a list."""
    found = Words(pa.array([words]))
    *_, (own, keys) = found.terms(np.arange(len(found.start)))
    return [Term(k, x, True) for k, x in zip(keys.tolist(), found.lead[own].tolist(), strict=True)]


def voters(mined: list[list[Term]]) -> Voters:
    """Voters for lists of mined terms, the fixed lists and the patterns. A term of several lists votes in each."""
    lists = [*mined, *[listed_terms(words) for words in INSULTS.values()]]
    rows = sorted((t.key, v, t.lead, t.strong) for v, terms in enumerate(lists) for t in terms)
    keys, voter, lead, strong = zip(*rows, strict=True)
    return Voters(np.array(keys, np.uint64), np.array(lead), np.array(strong), np.array(voter), len(mined))


def signals(column: pa.Array, known: Voters) -> tuple[np.ndarray, np.ndarray]:
    """Per text its votes (toxic ones by voter from bit 0, clean ones from bit 32) and the numbers that NUMBERS names.

    A lexicon votes toxic where a word has one of its strong terms or two words have any, else it abstains. Patterns vote
    toxic: a strong term within three words after a form of address, shouting, runs of exclamation marks, letters masked by
    signs, drawn-out letters, and two or more words with strong terms; ``several`` votes clean where no word has a term,
    ``plain`` where no pattern is found either. Texts without words get no vote.
    """
    w = Words(column)
    n = len(column)
    unique, start = np.unique(known.keys, return_index=True)
    word, place = w.found(unique, known.leads)
    lists = len(known.fixed) + known.mined
    count = np.diff(np.append(start, len(known.keys)))
    entry = flat.ranges(start[place], count[place])
    word = np.repeat(word, count[place])
    voter, is_strong = known.voter[entry], known.strong[entry]
    votes = np.zeros((n, lists), bool)
    votes[w.doc[word[is_strong]], voter[is_strong]] = True
    once = np.unique(word * lists + voter)
    votes |= np.bincount(w.doc[once // lists] * lists + once % lists, minlength=n * lists).reshape(n, lists) >= 2
    is_hit, is_sure, is_fixed = np.zeros((3, len(w.start)), bool)
    is_hit[word], is_sure[word[is_strong]], is_fixed[word[voter >= known.mined]] = True, True, True
    words = np.diff(w.first)

    def per_text(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, of_words, n)

    hits, sure, fixed_hits = per_text(is_hit), per_text(is_sure), per_text(is_fixed)
    hashes = flat.span_hash(w.low, w.start[is_hit], w.end[is_hit])
    pairs = np.unique(np.stack([w.doc[is_hit].astype(np.uint64), hashes], 1), axis=0) if is_hit.any() else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n)
    address = np.isin(w.chunk & flat.LOW_BYTES[np.minimum(w.size, 8)], [int.from_bytes(a.encode(), "little") for a in ADDRESS.split()])
    near = np.zeros(len(is_hit), bool)
    for gap in (1, 2, 3):
        near[gap:] |= address[:-gap] & is_sure[gap:] & (w.doc[gap:] == w.doc[:-gap])
    byte_doc = flat.owners(w.offsets)

    def bytes_of(mask: np.ndarray) -> np.ndarray:
        return np.bincount(byte_doc, mask, n)

    inner = np.zeros(len(w.data), bool)
    same = w.low[1:] == w.low[:-1]
    letters, data = LETTER[w.data], w.data
    long_run, masked, exclaim = inner.copy(), inner.copy(), inner.copy()
    if len(data) > 3:
        long_run[3:] = same[2:] & same[1:-1] & same[:-2] & letters[3:] & (data[3:] < 0x80)
        long_run[3:] &= byte_doc[3:] == byte_doc[:-3]
    if len(data) > 2:
        masked[1:-1] = MASK[data[1:-1]] & letters[:-2] & letters[2:] & (byte_doc[:-2] == byte_doc[2:])
    if len(data) > 1:
        exclaim[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21) & (byte_doc[1:] == byte_doc[:-1])
    ascii_letters = bytes_of(letters & (data < 0x80))
    upper = bytes_of(UPPER[data]) / np.maximum(ascii_letters, 1)
    exclamations, masks = bytes_of(exclaim), bytes_of(masked)
    pattern = np.stack(
        [per_text(near) > 0, (upper > 0.3) & (ascii_letters >= 20), exclamations > 0, masks > 0, bytes_of(long_run) > 0, sure >= 2, np.zeros(n, bool)], 1
    )
    none = (words > 0) & (hits == 0)
    clean = np.zeros((n, lists + len(PATTERNS)), bool)
    clean[:, -2], clean[:, -1] = none, none & ~pattern.any(1)
    toxic = np.concatenate([votes, pattern], 1)
    bit = np.arange(toxic.shape[1])
    packed = (toxic.astype(np.int64) << bit).sum(1) | (clean.astype(np.int64) << (bit + 32)).sum(1)
    some = np.maximum(words, 1)
    numbers = np.stack(
        [np.log1p(sure), np.log1p(hits), np.log1p(distinct), np.sqrt(sure / some), np.sqrt(hits / some), np.log1p(fixed_hits), upper,
         np.log1p(exclamations), np.log1p(masks), np.log1p(words) / 10], 1,
    )
    return packed, numbers.astype(np.float32)


def _doc_terms(column: pa.Array, among: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their first bytes, and the number of the slice's texts that have each; only those ``among`` if it is given."""
    w = Words(column)
    if among is None:
        words, keys = (np.concatenate(x) for x in zip(*w.terms(np.arange(len(w.start))), strict=True))
    else:
        words, place = w.found(*among)
        keys = among[0][place]
    order = np.lexsort((w.doc[words], keys))
    words, keys = words[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (w.doc[words[1:]] != w.doc[words[:-1]])
    words, keys = words[fresh], keys[fresh]
    own, example, counts = np.unique(keys, return_index=True, return_counts=True)
    return own, w.lead[words[example]], counts


def _term_counts(texts: DataFrame, text_col: str, among: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, text_col):
            keys, leads, counts = _doc_terms(part.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(leads), pa.array(counts)], ["term", "lead", "n"])

    found = texts.select(text_col).mapInArrow(run, "term long, lead long, n long")
    return found.groupBy("term").agg(F.min("lead").alias("lead"), F.sum("n").alias("n"))


def mine_lexicons(toxic: DataFrame, clean: DataFrame, text_col: str = "text", lists: int = MINED) -> list[list[Term]]:
    """Terms that stand in more of the ``toxic`` texts than chance allows, dealt out to ``lists`` lexicons.

    Both tables are bounded samples. Of the toxic texts the CANDIDATES most frequent terms are counted in the clean ones.
    A term is taken, at most TERMS of them, if its log-likelihood ratio is beyond what the best of as many random terms
    would reach and its share of the toxic texts is over four times that of the clean ones; it is strong if that is over
    twenty times by a standard error at least. Terms with the same first bytes form a family, and families are dealt out
    in order of their best term, so a voter has whole families and nested beginnings don't vote twice.
    """
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return []
    counted = _term_counts(toxic, text_col).where("n > 1").orderBy(F.desc("n"), "term").limit(CANDIDATES).toArrow()
    terms, lead, a = (np.array(counted.column(c), np.int64) for c in ("term", "lead", "n"))
    order = np.argsort(terms.view(np.uint64))
    terms, lead, a = terms.view(np.uint64)[order], lead[order], a[order].astype(float)
    c = np.zeros(len(terms))
    if n_clean and len(terms):
        seen = _term_counts(clean, text_col, (terms, lead)).toArrow()
        c[np.searchsorted(terms, np.array(seen.column("term"), np.int64).view(np.uint64))] = np.array(seen.column("n"), float)

    def gain(part: np.ndarray, whole: float, share: np.ndarray) -> np.ndarray:
        expected = whole * share
        return part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)) + (whole - part) * np.log(np.maximum(whole - part, 1e-9) / np.maximum(whole - expected, 1e-9))

    share = (a + c) / (n_toxic + n_clean)
    ratio = 2 * (gain(a, n_toxic, share) + gain(c, n_clean, share))
    weight = np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    strong = weight - np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) > STRONG
    taken = np.flatnonzero((ratio > 2 * np.log(max(len(terms), 2))) & (weight > RARE))
    taken = taken[np.lexsort((terms[taken], -ratio[taken]))][:TERMS]
    family: dict[int, list[Term]] = {}
    for i in taken.tolist():
        family.setdefault(int(lead[i]), []).append(Term(int(terms[i]), int(lead[i]), bool(strong[i])))
    out: list[list[Term]] = [[] for _ in range(lists)]
    for i, members in enumerate(family.values()):
        out[i % lists] += members
    return [one for one in out if one]


@dataclass
class LabelModel:
    """Votes given a hidden label: a prior and, per label, each voter's vote given the vote of its parent voter.

    ``parent`` is -1 for a voter that depends on the label alone. ``table[y, i, a, b]`` is the log of voter i's chance to
    vote a (0 none, 1 toxic, 2 clean) where its parent votes b.
    """

    prior: float
    parent: np.ndarray
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        cast = vote_values(votes, len(self.parent))
        given = np.where(self.parent >= 0, cast[:, np.maximum(self.parent, 0)], 0)
        own = np.arange(len(self.parent))
        fit = [self.table[y, own, cast, given].sum(1) for y in (0, 1)]
        odds = fit[1] - fit[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def accuracies(self) -> np.ndarray:
        """Per voter the chance of a toxic vote for toxic and for clean texts, the parent abstaining."""
        return np.exp(self.table[::-1, :, TOXIC, 0]).T


def vote_values(votes: np.ndarray, count: int) -> np.ndarray:
    bit = np.arange(count)
    return (votes[:, None] >> bit & 1) * TOXIC + (votes[:, None] >> (bit + 32) & 1) * CLEAN


def _start(count: int, prior: float) -> LabelModel:
    """Voters that are better than chance and independent of each other."""
    chance = np.array([[0.60, 0.05, 0.35], [0.60, 0.35, 0.05]])
    return LabelModel(prior, np.full(count, -1), np.log(np.broadcast_to(chance[:, None, :, None], (2, count, 3, 3))).copy())


def _statistics(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    """Expected counts under the model: how often two voters cast two votes, by label; all rows of the corpus take part."""
    count = len(model.parent)
    side = 3 * count
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, side, side))
        for batch in batches:
            for at in range(0, batch.num_rows, PATTERN_ROWS):
                votes, known, n = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, PATTERN_ROWS).columns)
                q = np.where(known >= 0, known, shared.value.posterior(votes))
                cast = np.zeros((len(votes), side))
                cast[np.arange(len(votes))[:, None], 3 * np.arange(count) + vote_values(votes, count)] = 1
                for y, weight in enumerate((n * (1 - q), n * q)):
                    total[y] += cast.T @ (cast * weight[:, None])
        cell = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1)[cell])], ["cell", "value"])

    got = patterns.select("votes", "known", "n").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(2 * side * side)
    out[np.array(got.column("cell"), np.int64)] = np.array(got.column("value"), float)
    shared.unpersist()
    return out.reshape(2, count, 3, count, 3)


def _estimated(stats: np.ndarray, parent: np.ndarray) -> LabelModel:
    count = len(parent)
    own = np.arange(count)
    single = stats[:, own, :, own, :].transpose(1, 0, 2, 3)[:, :, np.arange(3), np.arange(3)]
    rows = single.sum(2)[:, :1, None]
    alone = (single + SMOOTHING / 3) / (rows + SMOOTHING)
    table = np.repeat(alone[..., None], 3, 3)
    for i in np.flatnonzero(parent >= 0):
        p = parent[i]
        joint = stats[:, i, :, p, :]
        table[:, i] = (joint + SMOOTHING * alone[:, i, :, None]) / (joint.sum(1, keepdims=True) + SMOOTHING)
    prior = (single[1, 0].sum() + 1) / (single[:, 0].sum() + 2)
    return LabelModel(float(np.clip(prior, 1e-4, 0.5)), parent, np.log(table))


def correlated_parents(stats: np.ndarray) -> np.ndarray:
    """The tree of voters whose votes tell most about each other beyond the label, by conditional mutual information.

    Voter 0's tree is grown by the strongest link at a time; a voter whose best link tells less than LEAST_LINK nats, or
    than chance would by the number of rows, stays without a parent.
    """
    count = stats.shape[1]
    rows = max(stats[:, 0].sum() / count, 1.0)
    p = (stats.transpose(0, 1, 3, 2, 4) + 1e-3) / rows
    y = p.sum((3, 4), keepdims=True)
    a, b = p.sum(4, keepdims=True), p.sum(3, keepdims=True)
    shared = (p * np.log(p * y / (a * b))).sum((0, 3, 4))
    np.fill_diagonal(shared, -1)
    parent, inside = np.full(count, -1), [0]
    while len(inside) < count:
        out = np.setdiff1d(np.arange(count), inside)
        link = shared[np.ix_(out, inside)]
        i, j = np.unravel_index(link.argmax(), link.shape)
        if link[i, j] > max(LEAST_LINK, np.log(rows + 1) * 4 / rows):
            parent[out[i]] = inside[j]
        inside.append(int(out[i]))
    return parent


def label_model(patterns: DataFrame, count: int, prior: float) -> LabelModel:
    """Accuracies and correlations of ``count`` voters by expectation maximisation over all rows of the corpus.

    ``patterns`` has the distinct ``votes`` with their number ``n`` and ``known`` (1, 0, or -1 where no label is known).
    Voters count as independent given the label at first; then the strongest correlations that are left make a tree, and
    the rounds after that know each voter's vote given its parent's. The tree is found again as the labels get better.
    Known rows keep their label.
    """
    model = _start(count, min(max(prior, 0.01), 0.5))
    for rounds in ROUNDS:
        for _ in range(rounds):
            stats = _statistics(patterns, model)
            model = _estimated(stats, model.parent)
        model = _estimated(stats, correlated_parents(stats))
    return model


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, votes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        x = (inputs(votes, numbers, len(self.voters.names)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.clip(x, -20, 20) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def inputs(votes: np.ndarray, numbers: np.ndarray, count: int) -> np.ndarray:
    cast = vote_values(votes, count)
    return np.concatenate([cast == TOXIC, (cast == CLEAN)[:, -2:], numbers], 1).astype(float)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = weight / weight.sum()
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - target)) + ridge * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(ids: DataFrame, sample: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("id"), "id").limit(sample)


def sketches(column: pa.Array) -> np.ndarray:
    """Per text the smallest of SKETCHES hashes of its runs of SKETCH_WORDS words, or the hash of all if it has fewer words:
    copies of a text have the same ones, near copies share most, others none."""
    w = Words(column)
    hashes = flat.span_hash(w.low, w.start, w.end)
    count = np.diff(w.first)
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(SKETCH_WORDS):
        rolled = flat.mix(rolled + SALTS[i])
        rolled[: max(len(hashes) - i, 0)] ^= hashes[i:]
    whole = np.maximum(count - SKETCH_WORDS + 1, (count > 0).astype(np.int64))
    at, bounds = flat.ranges(w.first[:-1], whole), np.cumsum(whole) - whole
    out, some = np.zeros((len(count), SKETCHES), np.uint64), whole > 0
    for k in range(SKETCHES if some.any() else 0):
        out[some, k] = np.minimum.reduceat(flat.mix(rolled[at] ^ SALTS[k]), bounds[some])
    for d in np.flatnonzero((count > 0) & (count < SKETCH_WORDS)).tolist():
        out[d] = xxhash.xxh3_64_intdigest(hashes[w.first[d] : w.first[d + 1]].tobytes())
    return out.view(np.int64)


def learn_voters(docs: DataFrame, known: DataFrame, sample: int = SAMPLE_ROWS) -> Voters:
    """Voters from at most ``sample`` toxic and ``sample`` clean texts of ``docs`` (id, text), chosen by hash of the id;
    ``known`` has ids and labels. Both broadcasts have at most twice that many ids.

    Of texts that share a sketch only the one with the smallest id counts, or all the words of a text with many copies
    would look toxic.
    """
    chosen = _sampled(known.where("known = 1"), sample).unionByName(_sampled(known.where("known = 0"), sample))
    texts = docs.join(F.broadcast(chosen), "id").select("id", "known", "text")
    field, ends = T.StructField("sketches", T.ArrayType(T.LongType())), SKETCHES

    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * ends, pa.array(sketches(column).reshape(-1)))]

    marked = written(flat.appended(texts, "text", [field], compute), "labelled")
    marked = marked.withColumn("row", F.struct("id", F.xxhash64("text")))
    first = marked.select("row", "known", F.posexplode("sketches")).groupBy("known", "pos", "col").agg(F.min("row").alias("row"))
    single = first.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == SKETCHES).select("row")
    own = marked.join(F.broadcast(single), "row").select("known", "text")
    return voters(mine_lexicons(own.where("known = 1"), own.where("known = 0")))


def signal_table(docs: DataFrame, known: Voters, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``votes`` and ``numbers`` of every text, from one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    width = len(NUMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.pieces(batches, "_text"):
            votes, numbers = signals(part.column("_text"), shared.value)
            lists = pa.ListArray.from_arrays(np.arange(len(votes) + 1, dtype=np.int32) * width, pa.array(numbers.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(votes), lists], [*keep, "votes", "numbers"])

    fields = [*rows.schema.fields[:-1], T.StructField("votes", T.LongType()), T.StructField("numbers", T.ArrayType(T.FloatType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NUMBERS))


def _classifier(signal: DataFrame, known: Voters, labels: LabelModel, sample: int) -> Model:
    """A linear classifier of the posterior labels, on at most ``sample`` rows that are rather toxic and as many others.
    Where a label is known it is the posterior."""
    count = len(known.names)
    shared = signal.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("votes", "known"))
            q = np.where(known >= 0, known, shared.value.posterior(votes)).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q)], [*batch.schema.names, "posterior"])

    learned = signal.where("learn").select("id", "known", "votes", "numbers")
    judged = learned.mapInArrow(run, T.StructType([*learned.schema.fields, T.StructField("posterior", T.DoubleType())]))
    rather = F.col("posterior") >= 0.5
    sizes = judged.agg(F.sum(rather.cast("long")), F.sum((~rather).cast("long"))).first()
    votes, numbers, target, weight = [], [], [], []
    for size, part in zip(sizes, (judged.where(rather), judged.where(~rather)), strict=True):
        got = part.orderBy(F.xxhash64("id", "votes"), "id", "votes", "posterior").limit(sample).toArrow().combine_chunks()
        if got.num_rows:
            votes.append(np.array(got.column("votes"), np.int64))
            numbers.append(np.array(got.column("numbers").combine_chunks().flatten(), np.float32).reshape(-1, len(NUMBERS)))
            target.append(np.array(got.column("posterior"), float))
            weight.append(np.full(got.num_rows, size / got.num_rows))
    width = count + 2 + len(NUMBERS)
    if not votes:
        return Model(known, labels, np.zeros(width), np.ones(width), np.zeros(width + 1))
    x = inputs(np.concatenate(votes), np.concatenate(numbers), count)
    centre, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    weights = fit_linear((x - centre) / scale, np.concatenate(target), np.concatenate(weight))
    return Model(known, labels, centre, scale, weights)


def _known(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(learn)
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("known"))


def _trained(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[Model, DataFrame]:
    known = written(_known(labels, learn, id_col, label_col), "known")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    voter = learn_voters(rows.select("id", "text"), known, sample)
    signal = written(signal_table(rows, voter, ["id", "learn"]), "signals")
    marked = signal.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(-1)))
    patterns = written(marked.groupBy("votes", "known").agg(F.count(F.lit(1)).alias("n")), "patterns")
    share = known.agg(F.avg("known")).first()[0]
    model = label_model(patterns, len(voter.names), 0.1 if share is None else share)
    return _classifier(marked, voter, model, sample), signal


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_ROWS,
) -> Model:
    """A model of toxic texts from all ``docs`` and the labels of those with ``learn`` (a null condition is false).

    Lexicons are mined from a bounded sample of labelled texts, the votes of all documents train the label model, and a
    bounded sample of its labels (``sample`` of each kind) trains the classifier. Labels other than 0 and 1 and rows
    without an id are ignored; of several labels of an id the largest counts. Without labels or with none of a kind the
    fixed lists and patterns are the voters; without documents every score is 0.5.
    """
    return _trained(docs, labels, learn, id_col, text_col, label_col, sample)[0]


def _verdicts(score: np.ndarray, threshold: float) -> list[pa.Array]:
    return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows and columns with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have one score of their own. Columns named ``score`` or ``predicted`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list[pa.Array]:
        return _verdicts(shared.value.score(*signals(column, shared.value.voters)), threshold)

    return flat.appended(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7, sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """``id_col, learn, score, predicted`` for every row of ``docs``, by a model trained on them (see ``train``).

    Texts are read once for their votes and numbers, which are stored; training and scoring work on that narrow table.
    Repeated and null ids are rows like others. Other columns are not read.
    """
    model, signal = _trained(docs, labels, learn, id_col, text_col, label_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = batch.column("votes").to_numpy(zero_copy_only=False)
            values = shared.value.score(votes, _numbers(batch.column("numbers")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("learn"), *_verdicts(values, threshold)], [id_col, "learn", "score", "predicted"])

    ids = signal.schema["id"].dataType
    fields = [T.StructField(id_col, ids), T.StructField("learn", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return signal.select("id", "learn", "votes", "numbers").mapInArrow(run, T.StructType(fields))
