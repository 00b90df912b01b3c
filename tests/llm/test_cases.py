"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, one small table for all operators."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import decontamination, exact_dedup, flat, jaccard_join, language_model, packing, quality, sharding, suffix_dedup, token_files, tokens, url_filters
from tracewell.llm.components import components
from tracewell.llm.decontamination import Automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i * i % 977}" for i in range(20_000))
NEAR = [" ".join(["alpha", *[f"w{i}" for i in range(100)], tail]) for tail in ("x", "y", "z")]
ROWS = [
    (1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "One two THREE four five six", "d"), (5, "one two three four five six", "e"),
    (5, "one two three four five six", "e"), (None, "one two three four five six", "f"), (6, LONG, "g"), (7, LONG + " end", "h"),
    (8, "é ü 中文 İ", "i"), (9, NEAR[0], "j"), (10, NEAR[1], "k"), (11, NEAR[2], "l"), (12, "short", None),
]
SCHEMA = "doc_id long, text string, rule string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("score", "n_hit", "keep", "mark", "shard", "root", "h"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got[(1, 2, 2, False)] == 1 and got[(2, 2, 2, True)] == 1
    assert got[(5, 5, 4, True)] == 1 and got[(5, 5, 4, False)] == 1 and got[(None, 5, 4, False)] == 1
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 10
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_forced_cuts_agree():
    flat_text = np.frombuffer(b"a" * 100_000, np.uint8)
    cuts = exact_dedup.text_cuts(exact_dedup.cut_points(flat_text), 0, len(flat_text))
    assert cuts[-1] == len(flat_text) and all(b > a for a, b in zip(cuts, cuts[1:], strict=False))


def test_near(docs, none):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.similarity_components(docs).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 2), (None, 4, 2), (9, 9, 98), (10, 9, 98), (11, 9, 98), (12, 12, 1)} <= got
    assert next(c for d, c, _ in got if d == 7) == 6
    kept = jaccard_join.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9, 12] and kept.columns == docs.columns
    assert jaccard_join.similarity_components(none).count() == 0


def test_chain_of_links(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_split_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 3)
    rows = [(i, " ".join([f"v{i}", *[f"w{j}" for j in range(60)]])) for i in range(12)]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_oversize_fingerprint_is_split(spark, monkeypatch):
    """A passage in every document and groups of documents alike around it: right results, and no block over the bound."""
    search, bound = suffix_dedup.repeated_starts, 6000

    def bounded(texts, *rest):
        assert sum(map(len, texts)) <= 2 * bound
        return search(texts, *rest)

    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", bound)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", bounded)
    rng = np.random.default_rng(5)

    def noise(n):
        return rng.integers(97, 123, n, np.uint8).tobytes().decode()

    passage, spaces = noise(700), " " * 60
    heads, tails = [noise(300) for _ in range(7)], [noise(300) for _ in range(5)]
    texts = []
    for i in range(60):
        head, tail = heads[i % 7][i % 11 :] if i % 2 else "", tails[i % 5][: 300 - i % 13] if i % 3 else ""
        texts.append(noise(250) + head + passage + tail + noise(250) + spaces + noise(350) + spaces)
    texts += [texts[0], texts[1][100:900], noise(30) + passage[:450], passage[200:] + spaces * 8, spaces * 9]
    raw = [t.encode() for t in texts]
    seen = collections.Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame).collect()}
    for d, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("name", "fold"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_special_token_strings(spark, name, fold):
    """Ids of texts with the tokenizer's own added tokens in them, against a plain tokenizer as it is loaded."""
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [
        f"a {end} b", end, f"{end}{end}", f"x{end}y {start} z", f"A <|ENDOFTEXT|>  b {end}", f"caf\u00e9{end}! \u4e2d{start}\u6587", f" {end} \n\n {end}\n", "<|endof",
        "text|>", f"<{end}>", f"<|endof{end}text|>", f"it's{end}'s 12{end}3", None, "", f"One, two {end}.{start}\tThree  {end} ", "no such string", f"e{end}\u0301", end[:-1], ">",
    ]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = tokens.PieceEncoder(public_tokenizers.path(name), fold)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    read = token_files.token_files(frame, public_tokenizers.path(name), end_id=2, fold=fold, with_ids=False)
    crc = {i: zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for i, w in enumerate(want)}
    assert {r.doc_id: r.ids_crc32 for r in read.collect()} == crc
    packed = packing.pack(frame, public_tokenizers.path(name), end_id=2, with_ids=False) if not fold else None
    assert packed is None or {r.doc_id: r.ids_crc32 for r in packed.collect()} == crc


def test_repeats(spark, docs, none):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    # The text has a period of 977 words, so the space after its last word closes a string that occurs earlier.
    assert got[6].n_removed == got[6].n_bytes and got[7].kept == b"end"
    assert got[1].n_bytes == 0 and got[8].n_removed == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repeated_starts(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 99, int(n)).astype(np.uint8).tobytes() for n in rng.integers(12, 120, 12)]
    counts = [len(t) - 9 for t in texts]
    seen = collections.Counter(t[i : i + 10] for t, n in zip(texts, counts, strict=True) for i in range(n))
    want = [[seen[t[i : i + 10]] > 1 for i in range(n)] for t, n in zip(texts, counts, strict=True)]
    assert [m.tolist() for m in suffix_dedup.repeated_starts(texts, counts, [1] * 12, 10)] == want


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    rng = np.random.default_rng(seed)
    items = [(i, rng.integers(0, 3, int(n)).tolist()) for i, n in enumerate(rng.integers(1, 9, 8))]
    text = rng.integers(0, 3, 60).tolist()
    want = set()
    for i, w in items:
        size = min(4, len(w))
        for a in range(len(w) - size + 1):
            want |= {(p, i) for s in range(61 - size) if text[s : s + size] == w[a : a + size] for p in range(s, s + size)}
    found = {(p, i) for a, b, its in Automaton(items, 4).matches(text) for p in range(a, b) for i in its}
    assert {p for p, _ in found} == {p for p, _ in want} and {i for _, i in found} == {i for _, i in want}


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "two three four"), (2, None), (None, "one"), (3, ""), (4, NEAR[0])], "item_id long, text string")
    seen = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert seen[4].n_hit == 4 and seen[4].hit_items == [1] and seen[9].hit_items == [4] and seen[1].n_words == 0
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, max_coverage=0.7).collect()}
    assert cut[12] == "short" and cut[4] == " five six" and 9 not in cut and cut[1] is None
    assert decontamination.decontaminate(docs, items).columns == docs.columns
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_decontamination_sends_a_text_once(spark, docs, monkeypatch):
    sent, appended = [], flat.appended
    monkeypatch.setattr(flat, "appended", lambda df, *rest: sent.append(df.schema.json()) or appended(df, *rest))
    items = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert sent[0].count('"name":"text"') == 1
    only = decontamination.decontaminate(docs.select("text"), items)
    assert only.columns == ["text"] and only.count() == len(ROWS) - 4


def test_slices_and_batches_are_small(spark):
    flat.small_batches(spark)
    texts = spark.range(3000).selectExpr("repeat('abcd efgh ', 1000) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            slices = [part.nbytes for part in flat.pieces([batch], "text")]
            yield pa.RecordBatch.from_pydict({"batch": [batch.nbytes], "slice": [max(slices)]})

    rows = texts.mapInArrow(sizes, "batch long, slice long").collect()
    assert max(r["batch"] for r in rows) < 6 << 20 and max(r["slice"] for r in rows) < 5 << 20


def test_arrays_are_made_of_small_slices(monkeypatch):
    texts = pa.array([None, "", " ", "a b", *(" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(200))])
    seen, released, words = [], [], flat.words
    monkeypatch.setattr(flat, "words", lambda data, *rest: seen.append(len(data)) or words(data, *rest))
    monkeypatch.setattr(flat, "release", lambda: released.append(1))
    values, bounds = jaccard_join.shingle_sets(texts)
    one_by_one = [jaccard_join.shingle_sets(texts[i : i + 1])[0] for i in range(len(texts))]
    assert (values == np.concatenate(one_by_one)).all() and np.diff(bounds).tolist() == list(map(len, one_by_one))
    assert len(jaccard_join.shingle_sets(texts[:0])[0]) == 0
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert max(seen) <= 1 << 20 < batch.nbytes
    parts = [part for part, _, _ in tokens.encoded([batch], public_tokenizers.path("byte_bpe_50k.json"), False, 1)]
    assert sum(p.num_rows for p in parts) == len(texts) and max(len(flat.texts(p.column(0))[0]) for p in parts) <= 1 << 20
    assert released == [1]
    few, many = (tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=n) for n in (2000, 2_000_000))
    for i in range(0, 20, 2):
        assert few.encode(texts[i : i + 2])[0].tolist() == many.encode(texts[i : i + 2])[0].tolist()
    assert len(few.hashes) < len(many.hashes)


def test_packing(docs, none):
    got = packing.pack(docs, PATH, 1, packing.Limits(tokens=64, segments=3, loss_tokens=40)).toPandas()
    by = got.groupby("sequence_id")
    assert (by.length.sum() <= 64).all() and (by.size() <= 3).all() and (by.loss_tokens.sum() <= 40).all()
    assert len(got[got.doc_id == 5].query("start == 0")) == 2 and got.doc_id.isna().any()
    assert packing.pack(none, PATH, 1).count() == 0


def test_token_files(docs, none):
    got = token_files.token_files(docs, PATH, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in got)
    assert token_files.token_files(none, PATH, 2).count() == 0


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 9], list(range(1, 400)), [2**i for i in range(30)]])
def test_codes(counts):
    counts = np.array(counts, np.int64)
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= token_files.MAX_BITS and (lengths > 0).sum() == (counts > 0).sum()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    codes = token_files.canonical(lengths)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 3000).astype(np.uint32)
    data = token_files.encode_segment([7, None], [ids[:1000], ids[1000:]], lengths, codes)
    names, sizes, back = token_files.decode_segment(data, token_files.decode_table(lengths, codes))
    assert names == [7, None] and sizes.tolist() == [1000, 2000] and (back == ids).all()


def test_sharding(spark, docs, none):
    meta = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    got = sharding.kd_shards(meta, 4, ["size", "doc_id"], "size", "text").collect()
    assert len(got) == len(ROWS) and {r.shard for r in got} <= set(range(4))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(10).alias("size"), F.lit("t").alias("text"))
    sizes = [r["count"] for r in sharding.kd_shards(same, 5, ["doc_id"], "size", "text").groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4
    assert sharding.kd_shards(none.withColumn("size", F.lit(1)), 4, ["size"], "size", "text").count() == 0


def test_language_model(docs, none):
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.col("doc_id") == 4).collect()}
    assert got[1].n_tokens == 1 and got[4].held_out and not got[5].held_out and got[4].n_known == 7
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got.values())
    assert language_model.score_texts(none, F.lit(False)).count() == 0
    assert language_model.score_texts(docs, F.lit(True)).count() == len(ROWS)


def test_quality(docs, none):
    model = quality.train(docs, none.select("doc_id"), F.lit(True))
    assert model is None
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(r.score == 0.5 and r.predicted == 1 for r in scored)
    model = quality.train(docs, docs.where("doc_id > 5").select("doc_id"), F.lit(True))
    again = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert again[1] == again[2] and all(0 <= s <= 1 for s in again.values())
    assert quality.score(none, model).count() == 0


def test_urls(spark):
    rules = url_filters.rule_table(spark, [("block", "net/"), ("allow", "a.net/x/"), ("block", "a.net/x/y/"), ("allow", "net/"), ("block", "org/"), ("allow", None), ("allow", "noslash")])
    urls = {
        None: ("", None, "allow"), "": ("", None, "allow"), "nothing": ("", None, "allow"), "http://NET/": ("net", "net/", "block"),
        "http://a.net/x/z?q#f": ("a.net", "a.net/x/", "allow"), "http://b.a.net/x/y/": ("b.a.net", "a.net/x/y/", "block"), "http://a.net": ("a.net", None, "allow"),
        "http://anet/": ("anet", None, "allow"), "s://c.net/\U0010ffff": ("c.net", "net/", "block"), "x://y://net/": ("y:", None, "allow"), "http://a..org/": ("a..org", "org/", "block"),
    }
    pages = spark.createDataFrame([(u, "old") for u in urls for _ in range(2)], "url string, rule string")
    got = url_filters.match_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.rule, r.verdict) == urls[r.url], r
    few = url_filters.match_urls(pages, rules, sweep_rows=3).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))
    assert url_filters.match_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.match_urls(pages, rules.limit(0)).collect()} == {"allow"}
