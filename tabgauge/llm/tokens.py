"""Token counts through a cache of content digests.

A text is known by the SHA-256 of its normalised content (null as empty; nothing else
may change, since every character can change the count) and by the version of the
tokenizer: the SHA-256 of its file and of the counting rule. Counts known to the cache
are joined. Of the rest, one text per digest is kept, copies merging before the shuffle;
those distinct misses alone are encoded and appended to the cache.

The cache is a Parquet table (version, digest, n_tokens). Counts are those of the
``tokenizers`` library. Texts below U+3000 are counted by ``tiktoken`` over the same
vocabulary, which gives the same tokens several times faster; the agreement was
established for every code point of that range. All other texts, and any that it
refuses, go to ``tokenizers`` itself.

Defined results: null text has 0 bytes and 0 tokens; repeated rows repeat; an empty
table gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.bpe import byte_letters
from tabgauge.llm.common import whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULE = "no added special tokens; special strings in the text are special; whole text"
CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
LIMIT = 512
TOGETHER = 256
# The cutting rule of byte-level vocabularies of this kind, a fixed value.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = re.compile("[^\x00-⿿]")


def version_of(content: bytes) -> str:
    return hashlib.sha256(content + RULE.encode()).hexdigest()


class Counter:
    """Counts tokens as the library does for a tokenizer file."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self.fast_twin(json.loads(content))

    @staticmethod
    def fast_twin(model: dict):
        """The same vocabulary for tiktoken, if the file is plain byte-level BPE."""
        import tiktoken

        core, cut = model["model"], model["pre_tokenizer"] or {}
        plain = (
            core["type"] == "BPE"
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not model["normalizer"]
            and not core.get("ignore_merges")
            and not core.get("dropout")
            and not any(
                t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]
            )
        )
        if not plain:
            return None
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in core["vocab"].items()}
        merged = [m if isinstance(m, list) else m.split(" ") for m in core["merges"]]
        made = [core["vocab"][a + b] for a, b in merged]
        if made != sorted(made) or len(ranks) != len(made) + 256:
            return None
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        return tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)

    def count(self, texts: list[str]) -> list[int]:
        counts: list[int] = [0] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.fast is None or WIDE.search(text):
                slow.append(i)
                continue
            try:
                counts[i] = len(self.fast.encode(text, allowed_special="all"))
            except BaseException as error:  # its native code panics on some long pieces
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
                slow.append(i)
        for i in slow:
            counts[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return counts


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if nothing has been stored."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(missing: DataFrame, content: bytes) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows."""
    held = missing.sparkSession.sparkContext.broadcast(content)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for part in parts:
            counts: list[int] = []
            for i in range(0, part.num_rows, TOGETHER):
                counts += counter.count(part.column(1).slice(i, TOGETHER).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return missing.mapInArrow(run, "digest binary, n_tokens bigint")


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, version.

    Counts that the cache lacks are added to it at once; the result reads the cache.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        content = file.read()
    version = version_of(content)
    text = whole_text(text_col)
    digest = F.unhex(F.sha2(text, 256))
    known = read_cache(spark, cache).where(F.col("version") == version)
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    if known.limit(1).count():
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    missing = texts.groupBy("digest").agg(F.first("text").alias("text"))
    (
        encode_misses(missing, content)
        .select(F.lit(version).alias("version"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )
    counts = read_cache(spark, cache).where(F.col("version") == version)
    # Two jobs that met the same miss may both have stored it.
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(
        col(id_col).cast("bigint").alias("id"),
        digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    return rows.join(counts, "digest").select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        F.lit(version).alias("version"),
    )
