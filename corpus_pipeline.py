"""A training corpus from raw documents: judged, deduplicated twice, cleared of test items, and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontamination, exact_dedup, flat, jaccard_join, packing, quality, queries
from tracewell.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.where("predicted = 1").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 2048 tokens."""
    out = packing.pack(docs, public_tokenizers.path(queries.BYTE_BPE), end_id=1, with_ids=False)
    return out.select(*queries.PACKED)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("packing", packed),
]

#: A trained classifier and a tokenizer have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat.small_batches(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
