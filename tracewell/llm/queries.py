"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import decontamination, exact_dedup, filter_audit, jaccard_join, language_model, packing, quality, sharding, suffix_dedup, token_files, toxicity, url_filters, vector_codes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query(
    f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
 p AS (SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
 r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
 ('org', '/fr/', 'allow')) AS t(rhost, rpath, verdict)),
 m AS (SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
 max_by(verdict, length(rhost || rpath)) AS verdict FROM p LEFT JOIN r
 ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
 SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
 FROM p JOIN m ON p.page_id = m.page_id AND p.host = m.host AND p.path = m.path"""
)
def op8_url_filters(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    out = url_filters.match_urls(pages, url_filters.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


@query(
    f"""WITH n AS (SELECT doc_id, {SQL_LOWER.format("text")} AS t FROM documents),
 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""
)
def op5_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


BYTE_BPE = "byte_bpe_50k.json"
PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@query()
def op7_packing(spark, sf):
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1, with_ids=False)
    return packed.select(*PACKED)


def _items_digest():
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return F.sha2(F.array_join(names, ","), 256)


@query()
def op9_decontamination(spark, sf):
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    seen = decontamination.contamination(docs, items)
    return seen.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), _items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORD_BPE = "word_bpe_49k.json"


@query()
def op10_token_files(spark, sf):
    path = public_tokenizers.path(WORD_BPE)
    read = token_files.token_files(table(spark, sf, "documents"), path, end_id=2, fold=True, with_ids=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op6_sharding(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    meta = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text, size).alias("copy"),
        F.log2(size).alias("log_size"), F.pmod(F.xxhash64("source"), F.lit(4096)).alias("source_at"),
        F.pmod(F.xxhash64("lang"), F.lit(4096)).alias("lang_at"),
    )
    out = sharding.kd_shards(meta, 24, ["log_size", "source_at", "lang_at", "doc_id"], "size", "copy")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def held_out(n: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == rest


def quality_model(docs, labels):
    """The classifier of the query and of the pipeline: labels of every fifth document are never read."""
    return quality.train(docs, labels.where("quality = 1").select("doc_id"), ~held_out(5, 0))


@query()
def op1_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op4_jaccard_join(spark, sf):
    return jaccard_join.similarity_components(table(spark, sf, "documents").select("doc_id", "text"))


@query()
def op3_language_model(spark, sf):
    return language_model.score_texts(table(spark, sf, "documents").select("doc_id", "text"), held_out(7, 2))


@query()
def op2_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text")).drop("kept")


@query(
    """WITH t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents d),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
 min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
 l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT
 + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
 + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
 FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x)
 AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
 s AS (SELECT o, i AS step, 1 << (instr('ABCDE', substr(o, i, 1)) - 1) AS own,
 coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (instr('ABCDE', substr(o, j, 1)) - 1))), 0)::INT AS earlier
 FROM o, (SELECT unnest(range(1, 6))::INT AS i)),
 r AS (SELECT part, o AS filter_order, step, own, sum(n * ((mask & own) = 0 AND (mask & earlier) = 0)::INT) AS kept,
 sum(n * ((mask & own) <> 0 AND (mask & earlier) = 0)::INT) AS removed,
 sum(n * ((mask & own) <> 0 AND (mask & earlier) <> 0)::INT) AS redundant, sum(n * (mask = own)::INT) AS unique_fails,
 sum(n * (good AND (mask & own) <> 0 AND (mask & earlier) = 0)::INT) AS good_lost,
 sum(n * (toxic AND (mask & own) <> 0 AND (mask & earlier) = 0)::INT) AS toxic_lost
 FROM g, s GROUP BY part, o, step, own)
 SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
 unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""
)
def op13_filter_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    failed = filter_audit.document_failures(docs, table(spark, sf, "labels"))
    lost = {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    return filter_audit.filter_interactions(failed, "ABCDE", lost=lost).drop("filter")


def _codes_sql(rounds: int) -> str:
    """The same codes by comparing every part with every entry; one step of SQL for each round."""

    def nearest(codebook: str) -> str:
        return f"""SELECT row, part, min({{'d': d, 'e': e}}) AS best FROM (SELECT row, v.part, e, sum((x - y) * (x - y)) AS d
 FROM v JOIN {codebook} c ON v.part = c.part AND v.pos = c.pos GROUP BY ALL) GROUP BY row, part"""

    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, * FROM embeddings WHERE embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """v AS MATERIALIZED (SELECT row, (i // (len(embedding) // 8))::INT AS part, (i % (len(embedding) // 8))::INT AS pos,
 floor(4096 * embedding[i + 1])::BIGINT AS x FROM (SELECT row, embedding, unnest(range(0, len(embedding))) AS i FROM k))""",
        "c0 AS (SELECT part, (row - 1)::INT AS e, pos, x AS y FROM v WHERE row <= 16)",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, c.pos, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{r} c LEFT JOIN
 (SELECT v.part, best.e AS e, pos, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} a ON v.row = a.row AND v.part = a.part GROUP BY ALL) m
 ON c.part = m.part AND c.e = m.e AND c.pos = m.pos)"""
        )
    steps.append(f"z AS MATERIALIZED ({nearest(f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}, b AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, pos)) AS digest FROM c{rounds}),
 o AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY row)
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
 FROM k JOIN o ON k.row = o.row, b"""


@query(_codes_sql(vector_codes.ROUNDS))
def op12_vector_codes(spark, sf):
    return vector_codes.vector_codes(table(spark, sf, "embeddings"))


@query()
def op11_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf, "labels"), ~held_out(3, 1))
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", "predicted")
