"""A corpus pipeline: documents in, the token ids of the mix out.

Each stage takes (spark, docs, sf_dir), returns a DataFrame, and is written as Parquet
before the next one reads it. All but the last return the columns of ``documents``.

1. language_id: documents of no recognised language go.
2. exact_dedup: of equal texts, the one with the smallest id stays.
3. ngram_jaccard: of documents linked by five-word shingles at a similarity of 0.8,
   one per group stays.
4. mixing: documents are repeated or dropped so that sources meet their target weights.
5. bpe: each document with its token ids, and the SHA-256 of the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabgauge.llm import bpe, exact, jaccard, langid, mixing
from tabgauge.llm.common import documents, saved

WORDS = 5
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs, words=WORDS, percent=PERCENT)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

# The stages on fitted centroids, iterated balancing and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
