"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabgauge.llm import (
    bpe,
    conversations,
    exact,
    jaccard,
    langid,
    mixing,
    pii,
    pivots,
    simhash,
    suffix,
    tokens,
    warc,
    whitening,
)
from tabgauge.llm.common import documents
from tabgauge.session import scratch_path


TOKENIZER = "byte_bpe_50k.json"


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), real=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(TOKENIZER)
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer, scratch_path(spark))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.captures(warc.assemble(warc.read_records(spark, path), payload=False))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(TOKENIZER)
    return bpe.encode(documents(spark, sf_dir), tokenizer, real=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.simhash_components(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_conversations(rows, damaged=True, real=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_personal_data,
        op2_exact_dedup,
        op3_mixing,
        op4_fingerprints,
        op5_repeats,
        op6_token_counts,
        op7_warc,
        op8_jaccard,
        op9_bpe,
        op10_language,
        op11_pivots,
        op12_whitening,
        op13_conversations,
    )
}

OP2_SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256,
           row_number() OVER () AS row
    FROM documents),
g AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(row) OVER w AS keep_row,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, row = keep_row AS kept, text_sha256 FROM g
"""

OP7_SQL = r"""
WITH d AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h
    FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
b AS (
    SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + (('0x' || substr(h, 1 + 5 * (k // 4), 5))::INTEGER >> (15 - 5 * (k % 4))) % 32
            AS INTEGER), 1), '' ORDER BY k) AS payload_digest
    FROM f, range(32) AS r(k) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f ON d.h = f.h JOIN b ON d.h = b.h
"""

SQL = {"op2_exact_dedup": OP2_SQL, "op7_warc": OP7_SQL}
